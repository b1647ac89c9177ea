"""Problem 6: lines repeated across the pages of one host.

Numbers, dates and names of each line are masked, the masked lines of a host are clustered by locality-sensitive
hashing (minhash bands over character shingles) and compared with the middle of their cluster by all minhashes, and
clusters on many pages are kept; the exact count of the pages on
which one and the same line stands then decides for `found`. Counting is in two steps (distinct line and page, then lines), so
that neither a host nor a line with a third of all rows meets in one task. Signatures travel once a line of a host, not with
its occurrences, and only to lines that can matter: `found` asks for lines on enough pages, so only those are banded.

Results: pages with a null host or a null or blank text have no repeated lines and keep their text; blank lines never
count. A line on exactly the least number of pages, or exactly the least share, counts as repeated. Lines of any length
are compared whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.llm.common import code_points, mix64, pieces
from weir.session import cut, spread

#: Pages of a host a line stands on at least, and their share of the host's pages.
LEAST_PAGES, LEAST_SHARE = 5, 0.1
#: Bands and rows a band, and characters in a shingle: two lines of similarity 0.8 share a band with probability 0.997.
BANDS, ROWS, SHINGLE = 8, 3, 5
#: Minhashes of a signature, a byte each, eight in one of its four numbers; the last two of each are in no band.
MINHASHES = 32
#: Minhashes a line has in common with the middle of its cluster at least.
ALIKE = 19
SIGNED = ["s0", "s1", "s2", "s3"]
#: Parts into which the rows of one frequent line are spread when they are marked.
SALTS = 16

#: Names to be masked: a capitalised word that doesn't begin the line, and what looks like an address.
NAME = regex.compile(r"(?<=\p{L}[\p{P}]*\s)\p{Lu}\p{Ll}+|\S+@\S+|\b[\w-]+(?:\.[\w-]+)+\b")
DIGITS = regex.compile(r"\d+")
#: Dates: runs of masked numbers with separators or month names between them.
DATE = regex.compile(r"0(?:\s*[-/.:,]\s*0)+|0 (?:\p{L}\p{M}*)+ 0")


def line_key(line: str) -> str:
    """One form for lines that differ only in letter case, in spacing or in runs of digits of any script."""
    return " ".join(DIGITS.sub("0", line.lower()).split())


def masked(line: str) -> str:
    """The key with names and dates masked; names are told by their capitals, so in the line as it is stored."""
    return DATE.sub("0", line_key(NAME.sub("N", line)))


def signatures(texts: list[str]) -> np.ndarray:
    """Four numbers a text, of eight minhashes each, cut to a byte.

    One permutation: each shingle falls into one of the `MINHASHES` bins, the least of a bin is its minhash; an empty bin takes
    that of the next one that isn't.
    """
    out = np.zeros((len(texts), len(SIGNED)), np.uint64)
    at = 0
    for group in pieces(texts, 1_000_000):
        points, offsets = code_points([t + "\0" * max(0, SHINGLE - len(t)) for t in group])
        x = points.astype(np.uint64)
        hashed = np.zeros(len(x) - SHINGLE + 1, np.uint64)
        for k in range(SHINGLE):
            hashed = hashed * np.uint64(0x100000001B3) ^ x[k : k + len(hashed)]
        hashed = mix64(hashed)
        owner = np.repeat(np.arange(len(group)), np.diff(np.append(offsets[:-1], len(x))))[: len(hashed)]
        inside = np.arange(len(hashed)) <= (np.append(offsets[1:-1], len(x)) - SHINGLE)[owner]  # shingles that lie within their text
        hashed, owner = hashed[inside], owner[inside]
        least = np.full(len(group) * MINHASHES, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(least, owner * MINHASHES + (hashed & np.uint64(MINHASHES - 1)).astype(np.int64), hashed >> np.uint64(5))
        least = least.reshape(-1, MINHASHES)
        empty = least == np.iinfo(np.uint64).max
        step = 1
        while empty.any():
            taken = np.roll(least, -step, 1)
            least = np.where(empty, taken, least)
            empty = least == np.iinfo(np.uint64).max
            step = min(2 * step, MINHASHES // 2)
        short = mix64(least + np.arange(MINHASHES, dtype=np.uint64)) & np.uint64(255)
        for k in range(MINHASHES):
            out[at : at + len(group), k // 8] |= short[:, k] << np.uint64(k % 8 * 8)
        at += len(group)
    return out


def line_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, host, page, line_no, a, b) of the non-blank lines; a and b are the 128-bit hash of the line's key."""
    for batch in batches:
        ids, hosts, urls, texts = (batch.column(k) for k in range(4))
        origin, numbers, code, of = [], [], [], {}
        for row, text in enumerate(texts.to_pylist()):
            for number, line in enumerate(text.split("\n")):
                if (key := line_key(line)) != "":
                    origin.append(row)
                    numbers.append(number)
                    code.append(of.setdefault(key, len(of)))
        if origin:
            rows = pa.array(origin, pa.int32())
            hashed = np.frombuffer(b"".join(xxhash.xxh3_128_digest(k) for k in of), np.int64).reshape(-1, 2)[np.array(code)]
            yield pa.RecordBatch.from_arrays([ids.take(rows), hosts.take(rows), urls.take(rows), pa.array(numbers, pa.int32()), pa.array(hashed[:, 0]), pa.array(hashed[:, 1])], names=["id", "host", "page", "line_no", "a", "b"])


def form_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, a, b, form, s0, s1, s2, s3) of the lines, once a host and spelling in a batch: the hash of the masked line and its signature."""
    for batch in batches:
        stored: dict[tuple[str, str], None] = {}
        for host, text in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            stored.update(dict.fromkeys((host, line) for line in text.split("\n") if line and not line.isspace()))
        rows = [(host, line, key) for host, line in stored if (key := line_key(line)) != ""]
        if rows:
            forms: dict[str, int] = {}
            of = np.array([forms.setdefault(masked(line), len(forms)) for _, line, _ in rows])
            hashed = np.frombuffer(b"".join(xxhash.xxh3_128_digest(key) for _, _, key in rows), np.int64).reshape(-1, 2)
            form = np.array([xxhash.xxh3_64_intdigest(f) for f in forms], np.uint64).view(np.int64)[of]
            signed = signatures(list(forms)).view(np.int64)[of]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _, _ in rows], pa.string()), pa.array(hashed[:, 0]), pa.array(hashed[:, 1]), pa.array(form), *(pa.array(signed[:, k]) for k in range(len(SIGNED)))], names=["host", "a", "b", "form", *SIGNED])


def with_text(pages: DataFrame) -> DataFrame:
    """Pages of a host with a text; `page` stands for the normalised address."""
    return pages.filter("host IS NOT NULL AND text IS NOT NULL").select("id", "host", F.xxhash64("normalized_url").alias("page"), "text")


def lines_of(pages: DataFrame) -> DataFrame:
    """The non-blank lines."""
    return spread(with_text(pages)).mapInArrow(line_batches, "id long, host string, page long, line_no int, a long, b long")


def standing(pages: DataFrame) -> DataFrame:
    """(host, a, b, page): each line once a page."""
    return lines_of(pages).select("host", "a", "b", "page").distinct()


def signed(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """The lines with the signature of one of their spellings, whichever is last by its form."""
    forms = spread(with_text(pages)).mapInArrow(form_batches, "host string, a long, b long, form long, s0 long, s1 long, s2 long, s3 long")
    one = forms.join(lines.select("host", "a", "b"), ["host", "a", "b"], "left_semi").groupBy("host", "a", "b").agg(F.max(F.struct("form", *SIGNED)).alias("one"))
    return lines.join(one, ["host", "a", "b"]).select(*lines.columns, *[f"one.{c}" for c in SIGNED])


def bands_of() -> Column:
    """Two of ROWS bytes out of each number of a signature."""
    return F.array(*[F.shiftrightunsigned(F.col(c), 8 * ROWS * k).bitwiseAND(F.lit((1 << 8 * ROWS) - 1)) for c in SIGNED for k in range(2)])


def common(one: list[Column], other: list[Column]) -> Column:
    """How many bytes two signatures have in common."""
    parts = []
    for x, y in zip(one, other, strict=True):
        z = x.bitwiseXOR(y)
        for step in (4, 2, 1):  # the lowest bit of each byte says whether any of its bits is set
            z = z.bitwiseOR(F.shiftrightunsigned(z, step))
        parts.append(8 - F.bit_count(z.bitwiseAND(F.lit(0x0101010101010101))))
    return sum(parts[1:], parts[0])


def host_pages(pages: DataFrame) -> DataFrame:
    """(host, all_pages): pages with a text that isn't blank."""
    return with_text(pages).filter(F.col("text").rlike(r"(?U)\S")).select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("all_pages"))


def clusters(pages: DataFrame, least: int = 1) -> DataFrame:
    """(host, a, b, pages, all_pages, cluster, cluster_pages, near): each line with the largest widespread cluster it is in.

    A cluster is the lines of a host that share a band and are like its middle, the line on most pages; `cluster_pages` is
    the number of different pages they stand on and `near` the number of different lines. A line is a cluster by itself too.
    Only lines on at least `least` pages are clustered.
    """
    stand = cut(standing(pages))
    counted = stand.groupBy("host", "a", "b").agg(F.count("*").alias("pages")).filter(F.col("pages") >= least)
    each = cut(signed(pages, cut(counted.join(host_pages(pages), "host"))))
    enough = lambda n: (F.col(n) >= LEAST_PAGES) & (F.col(n) >= LEAST_SHARE * F.col("all_pages"))
    key = ["host", "cluster"]
    banded = each.select("host", "a", "b", "pages", "all_pages", *SIGNED, F.posexplode(bands_of()).alias("band", "value")).withColumn("cluster", F.xxhash64("band", "value")).drop("band", "value")
    # the sum over the lines is at least the number of pages, so no widespread cluster is lost here
    sums = banded.groupBy(*key).agg(F.sum("pages").alias("sum"), F.count("*").alias("lines"), F.max("all_pages").alias("all_pages")).filter((F.col("lines") > 1) & enough("sum")).select(*key)
    members = cut(banded.join(sums, key))
    middles = members.groupBy(*key).agg(F.max_by(F.struct(*SIGNED), F.struct("pages", "a", "b")).alias("m"))
    alike = cut(members.join(middles, key).filter(common([F.col(c) for c in SIGNED], [F.col(f"m.{c}") for c in SIGNED]) >= ALIKE).select(*key, "a", "b", "pages", "all_pages"))
    again = alike.groupBy(*key).agg(F.count("*").alias("near"), F.sum("pages").alias("sum"), F.max("all_pages").alias("all_pages")).filter((F.col("near") > 1) & enough("sum"))
    wide = alike.join(again.select(*key), key, "left_semi")
    spans = wide.select(*key, "a", "b").join(stand, ["host", "a", "b"]).select(*key, "page").distinct().groupBy(*key).agg(F.count("*").alias("cluster_pages"))
    kept = again.select(*key, "near", "all_pages").join(spans, key).filter(enough("cluster_pages")).select(*key, "cluster_pages", "near")
    several = wide.join(kept, key)
    alone = each.filter(enough("pages")).select("host", F.xxhash64("a", "b").alias("cluster"), "a", "b", "pages", "all_pages", F.col("pages").alias("cluster_pages"), F.lit(1).cast("long").alias("near"))
    best = F.struct("cluster_pages", "near", "cluster")
    joined = several.unionByName(alone)
    return joined.groupBy("host", "a", "b").agg(F.max("pages").alias("pages"), F.max("all_pages").alias("all_pages"), F.max(best).alias("best")).select("host", "a", "b", "pages", "all_pages", "best.cluster", "best.cluster_pages", "best.near")


def repeated_keys(pages: DataFrame) -> DataFrame:
    """(host, a, b) of the lines of widespread clusters that stand, the same, on enough pages by themselves."""
    found = clusters(pages, LEAST_PAGES)
    return found.filter((F.col("pages") >= LEAST_PAGES) & (F.col("pages") >= LEAST_SHARE * F.col("all_pages"))).select("host", "a", "b")


def marked(pages: DataFrame, keys: DataFrame) -> DataFrame:
    """(id, line_no) of the lines with these keys; the rows of one line are spread over several tasks."""
    salted = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    lines = lines_of(pages).withColumn("salt", F.pmod(F.col("id"), F.lit(SALTS)).cast("int"))
    return lines.join(salted, ["host", "a", "b", "salt"], "left_semi").select("id", "line_no")


def found(pages: DataFrame) -> DataFrame:
    """(id, line_no) of the repeated lines."""
    return marked(pages, repeated_keys(pages))


def cleaned(pages: DataFrame) -> DataFrame:
    """(id, kept_text, removed): each page's text without the lines of widespread clusters of near-duplicates; null texts stay null."""
    gone = marked(pages, clusters(pages).select("host", "a", "b")).groupBy("id").agg(F.collect_set("line_no").alias("gone"))
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda line, k: ~F.coalesce(F.array_contains("gone", k), F.lit(False))), "\n")
    return pages.select("id", "text").join(gone, "id", "left").select("id", kept.alias("kept_text"), F.coalesce(F.size("gone"), F.lit(0)).alias("removed"))
