"""The queries of this subpackage by name, and the SQL that some are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm import blocks, encode, langs, mixing, mojibake, neighbours, reading, repeats, residue, unify
from weir.sources.tables import table


def p1_excluded(spark: SparkSession, root: str) -> DataFrame:
    """Pages with a placeholder, or filler or a notice in place of their content; with coverage and kind."""
    return residue.excluded(table(spark, root, "crawled_documents"))


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """The pages to be excluded."""
    return p1_excluded(spark, root).select("id")


def p2_unified(spark: SparkSession, root: str) -> DataFrame:
    """Every title and text in one form, and whether it needed it."""
    return unify.unified(unify.fields_of(table(spark, root, "crawled_documents")))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Fields that needed the one form and were not decoded wrongly."""
    return p2_unified(spark, root).filter("needed").select("id", "field").join(p7_found(spark, root), ["id", "field"], "left_anti")


def p3_neighbours(spark: SparkSession, root: str) -> DataFrame:
    """The ten most similar vectors of every usable vector."""
    return neighbours.neighbours(table(spark, root, "page_embeddings"), table(spark, root, "embedding_models"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """The pairs of at least 0.90 of which one is among the other's ten most similar."""
    return neighbours.pairs(p3_neighbours(spark, root))


def p4_languages(spark: SparkSession, root: str) -> DataFrame:
    """The language of each text and of its long lines in another one, with confidence and what its record declares."""
    return langs.stretches(table(spark, root, "crawled_documents"), table(spark, root, "page_records"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Texts whose record doesn't name their language, and long lines in another one; without excluded and wrongly decoded pages."""
    left_out = p1_found(spark, root).unionByName(p7_found(spark, root).select("id")).distinct()
    return p4_languages(spark, root).filter("wrong").select("id", "line_no", "lang").join(left_out, "id", "left_anti")


def p5_bodies(spark: SparkSession, root: str) -> DataFrame:
    """Each page's main body."""
    return blocks.bodies(table(spark, root, "crawled_documents"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """The lines outside the main body, of pages that aren't excluded."""
    return blocks.outside(table(spark, root, "crawled_documents")).join(p1_found(spark, root), "id", "left_anti")


def p6_clusters(spark: SparkSession, root: str) -> DataFrame:
    """Per host, the lines in widespread clusters of near-duplicate lines."""
    return repeats.clusters(table(spark, root, "crawled_documents"))


def p6_cleaned(spark: SparkSession, root: str) -> DataFrame:
    """Each page's text without the lines of widespread clusters."""
    return repeats.cleaned(table(spark, root, "crawled_documents"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """The lines that stand on many pages of their host."""
    return repeats.found(table(spark, root, "crawled_documents"))


def p7_repaired(spark: SparkSession, root: str) -> DataFrame:
    """The affected fields, with what could be restored of them."""
    return mojibake.repaired(unify.fields_of(table(spark, root, "crawled_documents"))).filter("affected").drop("affected")


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """The fields of which all or a part was decoded wrongly."""
    return p7_repaired(spark, root).select("id", "field")


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    """Every document as ids."""
    return encode.encoded(table(spark, root, "documents"))


def p8_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    """Whether each document's ids decode to its text (null and empty texts to an empty one)."""
    documents = table(spark, root, "documents")
    back = encode.decoded(encode.encoded(documents))
    return documents.select("doc_id", "text").join(back, "doc_id").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))


def p9_mixture(spark: SparkSession, root: str) -> DataFrame:
    """The documents of the mixture and how often each is used."""
    return mixing.mixture(table(spark, root, "documents"), table(spark, root, "mix_targets"))[0]


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    """The share of each source, as it should be and as it is."""
    return mixing.mixture(table(spark, root, "documents"), table(spark, root, "mix_targets"))[1]


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """The sources that fall short of their share."""
    return p9_shares(spark, root).filter("short").select("source")


def p10_levels(spark: SparkSession, root: str) -> DataFrame:
    """The reading level of every document."""
    return reading.graded(table(spark, root, "documents"), table(spark, root, "reading_labels"))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    """The level of the ungraded documents in English or in Nepali in Devanagari that are long enough."""
    return reading.found(table(spark, root, "documents"), table(spark, root, "reading_labels"))


QUERIES = {f.__name__: f for f in (p1_excluded, p1_found, p2_unified, p2_found, p3_neighbours, p3_found, p4_languages, p4_found, p5_bodies, p5_found, p6_clusters, p6_cleaned, p6_found, p7_repaired, p7_found, p8_ids, p8_roundtrip, p9_mixture, p9_shares, p9_found, p10_levels, p10_found)}
ORACLE: dict[str, str] = {
    "p6_found": r"""
        WITH lines AS (
            SELECT id, host, normalized_url AS page, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no
            FROM crawled_documents WHERE host IS NOT NULL AND text IS NOT NULL),
        keyed AS (
            SELECT id, host, page, line_no, trim(regexp_replace(regexp_replace(lower(line), '\p{Nd}+', '0', 'g'), '[\s\p{Z}\x{85}\v]+', ' ', 'g')) AS key FROM lines),
        filled AS (SELECT * FROM keyed WHERE key <> ''),
        hosts AS (SELECT host, count(DISTINCT page) AS all_pages FROM filled GROUP BY host),
        keys AS (SELECT host, key, count(DISTINCT page) AS pages FROM filled GROUP BY host, key)
        SELECT f.id, CAST(f.line_no AS INTEGER) AS line_no FROM filled f JOIN keys k USING (host, key) JOIN hosts h USING (host)
        WHERE k.pages >= 5 AND k.pages >= 0.1 * h.all_pages""",
}
