"""Queries on the three-level hierarchy, on places and on polygons.

Regions, nations and suppliers stand for provinces, districts and local bodies; documents' ids spread them over these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.operators import keyed, places
from weir.plans.registry import literal, query
from weir.sources.tables import table

TAGS_SQL = """tags AS (SELECT doc_id AS tag, doc_id // 2 AS page, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 5) END AS province, CASE WHEN doc_id % 3 = 1 THEN (doc_id % 25) END AS district,
        CASE WHEN doc_id % 3 = 2 THEN 1 + doc_id % (SELECT count(*) FROM supplier) END AS local, (doc_id % 100) / 100.0 AS confidence FROM documents),
    chain AS (SELECT t.tag, t.page, t.confidence, t.local, coalesce(t.district, s.s_nationkey) AS district, coalesce(t.province, n.n_regionkey) AS province
        FROM tags t LEFT JOIN supplier s ON s.s_suppkey = t.local LEFT JOIN nation n ON n.n_nationkey = coalesce(t.district, s.s_nationkey))"""


def tags(spark: SparkSession, root: str) -> DataFrame:
    n = table(spark, root, "supplier").agg(F.count("*").alias("n")).scalar()
    level = F.col("doc_id") % 3
    return table(spark, root, "documents").select(
        F.col("doc_id").alias("tag"), F.floor(F.col("doc_id") / 2).alias("page"), F.when(level == 0, F.col("doc_id") % 5).alias("province"), F.when(level == 1, F.col("doc_id") % 25).alias("district"),
        F.when(level == 2, 1 + F.col("doc_id") % n).alias("local"), (F.col("doc_id") % 100 / 100).alias("confidence"),
    )


def chained(spark: SparkSession, root: str) -> DataFrame:
    """Tags with the codes above theirs filled in, the second from the first one's result."""
    local = table(spark, root, "supplier").select(F.col("s_suppkey").alias("local"), F.col("s_nationkey").alias("of_local"))
    district = table(spark, root, "nation").select(F.col("n_nationkey").alias("d"), F.col("n_regionkey").alias("of_district"))
    first = tags(spark, root).join(local, "local", "left").withColumn("district", F.coalesce("district", "of_local"))
    return first.join(district, F.col("district") == F.col("d"), "left").withColumn("province", F.coalesce("province", "of_district")).select("tag", "page", "confidence", "local", "district", "province")


@query(f"WITH {TAGS_SQL} SELECT tag, local, district, province FROM chain")
def geo_chain(spark: SparkSession, root: str) -> DataFrame:
    return chained(spark, root).select("tag", "local", "district", "province")


@query(f"WITH {TAGS_SQL} SELECT page, tag FROM chain QUALIFY row_number() OVER (PARTITION BY page ORDER BY confidence DESC, local IS NULL, district IS NULL, tag) = 1")
def primary_geo(spark: SparkSession, root: str) -> DataFrame:
    order = [F.desc("confidence"), F.col("local").isNull(), F.col("district").isNull(), F.col("tag")]
    return keyed.latest(chained(spark, root), ["page"], order).select("page", "tag")


LEVELS_SQL = """levels AS (SELECT page, 'province' AS level, province AS code FROM chain WHERE province IS NOT NULL UNION SELECT page, 'district', district FROM chain WHERE district IS NOT NULL UNION SELECT page, 'local', local FROM chain WHERE local IS NOT NULL),
    regions AS (SELECT 'province' AS level, r_regionkey AS code, r_name AS name, NULL AS parent FROM region UNION ALL SELECT 'district', n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 'local', s_suppkey, s_name, s_nationkey FROM supplier)"""


def levels(spark: SparkSession, root: str) -> DataFrame:
    """Each page once for each region it is in, on all levels."""
    stacked = chained(spark, root).select("page", F.expr("stack(3, 'province', cast(province AS long), 'district', cast(district AS long), 'local', cast(local AS long)) AS (level, code)"))
    return stacked.filter("code IS NOT NULL").distinct()


def regions(spark: SparkSession, root: str) -> DataFrame:
    row = lambda t, level, code, name, parent: table(spark, root, t).select(F.lit(level).alias("level"), F.col(code).cast("long").alias("code"), F.col(name).alias("name"), parent.cast("long").alias("parent"))
    return row("region", "province", "r_regionkey", "r_name", F.lit(None)).unionByName(row("nation", "district", "n_nationkey", "n_name", F.col("n_regionkey"))).unionByName(row("supplier", "local", "s_suppkey", "s_name", F.col("s_nationkey")))


@query(f"""WITH {TAGS_SQL}, {LEVELS_SQL} SELECT r.level, r.code, count(DISTINCT l.page) AS pages, count(d.doc_id) AS documents, max(d.published_at) AS newest, coalesce(string_agg(DISTINCT d.lang, ',' ORDER BY d.lang), '') AS langs
    FROM regions r LEFT JOIN levels l ON l.level = r.level AND l.code = r.code LEFT JOIN documents d ON d.doc_id = l.page GROUP BY 1, 2""")
def geo_content_stats(spark: SparkSession, root: str) -> DataFrame:
    """Counts for every region of every level, zeros too."""
    docs = table(spark, root, "documents").select(F.col("doc_id").alias("page"), "lang", "published_at")
    counted = levels(spark, root).join(docs.withColumn("known", F.lit(1)), "page", "left").groupBy("level", "code").agg(
        F.count_distinct("page").alias("pages"), F.count("known").alias("documents"), F.max("published_at").alias("newest"), F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("langs")
    )
    return regions(spark, root).select("level", "code").join(counted, ["level", "code"], "left").select("level", "code", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("documents", F.lit(0)).alias("documents"), "newest", F.coalesce("langs", F.lit("")).alias("langs"))


@query(f"""WITH {TAGS_SQL}, {LEVELS_SQL} SELECT grouping_id(province, district)::INTEGER AS g, province, district, count(DISTINCT page) AS pages FROM chain GROUP BY GROUPING SETS ((province, district), (province), ())""")
def geo_grouping_sets(spark: SparkSession, root: str) -> DataFrame:
    """The same roll-up as grouping sets."""
    sets = [["province", "district"], ["province"], []]
    return chained(spark, root).groupingSets(sets, "province", "district").agg(F.grouping_id().cast("int").alias("g"), F.count_distinct("page").alias("pages")).select("g", "province", "district", "pages")


@query(f"WITH {TAGS_SQL}, {LEVELS_SQL} SELECT r.code, r.name, count(DISTINCT l.page) AS pages FROM regions r LEFT JOIN levels l ON l.level = r.level AND l.code = r.code WHERE r.level = 'district' AND r.parent = 2 GROUP BY 1, 2")
def geo_within(spark: SparkSession, root: str) -> DataFrame:
    """The counts of one level within a parent."""
    wanted = regions(spark, root).filter("level = 'district' AND parent = 2")
    counted = levels(spark, root).filter("level = 'district'").groupBy("code").agg(F.count("*").alias("pages"))
    return wanted.join(counted, "code", "left").select("code", "name", F.coalesce("pages", F.lit(0)).alias("pages"))


@query(f"WITH {TAGS_SQL}, {LEVELS_SQL} SELECT level, code, name, parent FROM regions")
def gazetteer_flat(spark: SparkSession, root: str) -> DataFrame:
    return regions(spark, root)


@query("SELECT r.r_name AS province, string_agg(n.n_name || ':' || k, ',' ORDER BY n.n_name) AS districts FROM region r JOIN (SELECT n_name, n_regionkey, n_nationkey, count(s_suppkey) AS k FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL) n ON n.n_regionkey = r.r_regionkey GROUP BY 1")
def hierarchy_nested(spark: SparkSession, root: str) -> DataFrame:
    """The tree, districts nested in their province with the number of their local bodies, written as text."""
    locals_ = table(spark, root, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("k"))
    nested = table(spark, root, "nation").join(locals_, "n_nationkey", "left").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.sort_array(F.collect_list(F.struct("n_name", F.coalesce("k", F.lit(0)).alias("k")))).alias("d"))
    text = F.array_join(F.transform("d", lambda x: F.concat(x["n_name"], F.lit(":"), x["k"].cast("string"))), ",")
    return table(spark, root, "region").join(nested, "r_regionkey").select(F.col("r_name").alias("province"), text.alias("districts"))


@query("""SELECT 1 AS rank, 'local' AS level, s_name AS name FROM supplier WHERE s_suppkey = 7 UNION ALL SELECT 2, 'district', n_name FROM nation WHERE n_nationkey = (SELECT s_nationkey FROM supplier WHERE s_suppkey = 7)
    UNION ALL SELECT 3, 'province', r_name FROM region WHERE r_regionkey = (SELECT n_regionkey FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_suppkey = 7)""")
def regional_card(spark: SparkSession, root: str) -> DataFrame:
    """A region and those above it, the nearest first."""
    own = table(spark, root, "supplier").filter("s_suppkey = 7").join(table(spark, root, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").join(table(spark, root, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return own.select(F.expr("stack(3, 1, 'local', s_name, 2, 'district', n_name, 3, 'province', r_name) AS (rank, level, name)")).filter("name IS NOT NULL")


NAMES = "('Kusma Municipality', 1), ('Pokhara Metropolitan City', 2), ('Pokhara', 3), ('Lamjung District', 4), ('Nowhere', 5), ('kusma', 6), ('पोखरा महानगरपालिका', 7), ('Pokhara Upamahanagarpalika', 8), ('कुश्मा उपमहानगरपालिका', 9), ('Lamjung Province', 10)"
GAZETTEER = "('Pokhara', 'पोखरा', 'L1'), ('Kusma', 'कुश्मा', 'L2'), ('Lamjung', 'लमजुङ', 'D1'), ('Kusmanagar', 'कुश्मानगर', 'L3')"
KEY_SQL = "regexp_replace(regexp_replace(lower(trim({0})), '(sub-metropolitan city|submetropolitan city|metropolitan city|rural municipality|municipality|upamahanagarpalika|mahanagarpalika|nagarpalika|gaunpalika|gaupalika|province|district|उपमहानगरपालिका|महानगरपालिका|नगरपालिका|गाउँपालिका|प्रदेश|जिल्ला)', '', 'g'), '[\\s_.,''’()/-]', '', 'g')"


@query(f"""WITH n AS (SELECT id, {KEY_SQL.format('name')} AS k FROM (VALUES {NAMES}) v(name, id)), g AS (SELECT code, {KEY_SQL.format('en')} AS e, {KEY_SQL.format('ne')} AS d FROM (VALUES {GAZETTEER}) v(en, ne, code)),
    x AS (SELECT id, min(code) AS code FROM n JOIN g ON k = e OR k = d GROUP BY id HAVING count(DISTINCT code) = 1), p AS (SELECT id, min(code) AS code FROM n JOIN g ON starts_with(e, k) OR starts_with(k, e) GROUP BY id HAVING count(DISTINCT code) = 1)
    SELECT n.id, coalesce(x.code, p.code) AS code FROM n LEFT JOIN x USING (id) LEFT JOIN p USING (id)""")
def place_resolve(spark: SparkSession, root: str) -> DataFrame:
    """Place names to codes: exact in either language if only one fits, else the only one whose name begins alike."""
    return places.resolve(literal(spark, NAMES, "t(name, id)"), literal(spark, GAZETTEER, "t(en, ne, code)"))


SQUARES = "('A', array(named_struct('x', 0D, 'y', 0D), named_struct('x', 1D, 'y', 0D), named_struct('x', 1D, 'y', 1D), named_struct('x', 0D, 'y', 1D))), ('B', array(named_struct('x', 1D, 'y', 0D), named_struct('x', 2D, 'y', 0D), named_struct('x', 2D, 'y', 1D), named_struct('x', 1D, 'y', 1D)))"


@query("""WITH p AS (SELECT event_id AS id, (event_id % 37) / 16.0 AS x, (event_id % 23) / 16.0 AS y FROM events)
    SELECT id, CASE WHEN y <= 1 AND x <= 1 THEN 'A' WHEN y <= 1 AND x <= 2 THEN 'B' END AS code FROM p WHERE y <= 1 AND x <= 2""")
def point_in_polygon(spark: SparkSession, root: str) -> DataFrame:
    """Points to the polygon they are in, its edge included; where two fit, the lower code."""
    points = table(spark, root, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 37 / 16).alias("x"), (F.col("event_id") % 23 / 16).alias("y"))
    return places.locate(points, literal(spark, SQUARES, "t(code, ring)"))


@query("SELECT 'A' AS a, 'B' AS b, 2::BIGINT AS shared")
def spatial_neighbours(spark: SparkSession, root: str) -> DataFrame:
    """Polygons with at least two corners in common."""
    return places.adjacent(literal(spark, SQUARES, "t(code, ring)"))


@query("SELECT code, round(6378.137 * 6378.137 * radians(1) * sin(radians(1)), 3) AS area FROM (VALUES ('A'), ('B')) v(code)")
def polygon_area(spark: SparkSession, root: str) -> DataFrame:
    """Square kilometres on the sphere."""
    return places.areas(literal(spark, SQUARES, "t(code, ring)")).select("code", F.round("area", 3).alias("area"))


SIGNALS = "(1, 'Nepal', NULL, NULL, NULL, 'a.com'), (2, NULL, 'ne_NP', NULL, NULL, 'a.com'), (3, NULL, NULL, 'in-UP', NULL, 'a.org'), (4, NULL, NULL, NULL, 'ne', 'a.org'), (5, NULL, NULL, NULL, NULL, 'x.gov.np'), (6, NULL, NULL, NULL, NULL, 'x.co.uk'), (7, NULL, NULL, NULL, 'en', 'x.com'), (8, ' np ', NULL, NULL, NULL, 'x.com'), (9, 'Mars', 'ne-NP', NULL, NULL, 'x.com'), (10, NULL, 'ne', 'NP_BA', NULL, 'x.com'), (11, NULL, NULL, NULL, 'en-Latn-IN', 'x.com'), (12, NULL, NULL, 'Nepal', NULL, 'x.com'), (13, NULL, NULL, NULL, NULL, 'X.GOV.NP.')"
CODE_SQL = "CASE WHEN length(trim({0})) = 2 THEN upper(trim({0})) ELSE CASE lower(trim({0})) WHEN 'nepal' THEN 'NP' WHEN 'india' THEN 'IN' WHEN 'bhutan' THEN 'BT' WHEN 'bangladesh' THEN 'BD' WHEN 'pakistan' THEN 'PK' WHEN 'china' THEN 'CN' WHEN 'sri lanka' THEN 'LK' WHEN 'united states' THEN 'US' WHEN 'united kingdom' THEN 'GB' END END"
TERRITORY_SQL = "CASE WHEN len(list_filter(string_split_regex({0}, '[-_]'), lambda x: x <> '')) >= 2 THEN " + CODE_SQL.replace("{0}", "(list_filter(string_split_regex({0}, '[-_]'), lambda x: x <> ''))[-1]") + " END"


@query(f"""SELECT id, coalesce({CODE_SQL.format("address")}, {TERRITORY_SQL.format("locale")}, {CODE_SQL.format("regexp_replace(region, '^(.[^-_]*)[-_].*$', '\\1')")}, {TERRITORY_SQL.format("lang")}, CASE WHEN lower(split_part(lang, '-', 1)) = 'ne' THEN 'NP' END,
    CASE lower(split_part(rtrim(host, '.'), '.', -1)) WHEN 'np' THEN 'NP' WHEN 'in' THEN 'IN' WHEN 'bt' THEN 'BT' WHEN 'bd' THEN 'BD' WHEN 'pk' THEN 'PK' WHEN 'cn' THEN 'CN' WHEN 'lk' THEN 'LK' WHEN 'uk' THEN 'GB' WHEN 'us' THEN 'US' END) AS country
    FROM (VALUES {SIGNALS}) v(id, address, locale, region, lang, host)""")
def country_detect(spark: SparkSession, root: str) -> DataFrame:
    """The country by the first signal that tells it."""
    return places.country(literal(spark, SIGNALS, "t(id, address, locale, region, lang, host)")).select("id", "country")


METAS = "(1, '27.7;85.3', NULL), (2, NULL, '28.2, 83.9'), (3, '99;1', '27,84'), (4, NULL, NULL), (5, 'x', NULL)"


@query(f"""WITH c AS (SELECT id, CASE WHEN lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180 THEN lat END AS lat, CASE WHEN lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180 THEN lng END AS lng, n FROM (
        SELECT id, try_cast(trim(split_part(position, ';', 1)) AS DOUBLE) AS lat, try_cast(trim(split_part(position, ';', 2)) AS DOUBLE) AS lng, 1 AS n FROM (VALUES {METAS}) v(id, position, icbm)
        UNION ALL SELECT id, try_cast(trim(split_part(icbm, ',', 1)) AS DOUBLE), try_cast(trim(split_part(icbm, ',', 2)) AS DOUBLE), 2 FROM (VALUES {METAS}) v(id, position, icbm)))
    SELECT id, arg_min(lat, n) FILTER (WHERE lat IS NOT NULL) AS lat, arg_min(lng, n) FILTER (WHERE lat IS NOT NULL) AS lng FROM c GROUP BY id""")
def geo_from_meta(spark: SparkSession, root: str) -> DataFrame:
    """Coordinates out of a page's meta fields, the first pair that is one."""
    return places.coordinates(literal(spark, METAS, "t(id, position, icbm)"))


@query("""WITH n AS (SELECT domain, category, regexp_replace(lower(domain), '[^a-z].*$', '') AS name FROM domains),
    p AS (SELECT a.domain, b.domain AS other, 1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name))::DOUBLE AS ratio FROM n a JOIN n b ON a.category = b.category AND a.domain <> b.domain WHERE a.name <> '' AND b.name <> '')
    SELECT domain, other, round(ratio, 6) AS ratio FROM p WHERE ratio >= 0.75 QUALIFY row_number() OVER (PARTITION BY domain ORDER BY ratio DESC, other DESC) = 1""")
def fuzzy_match(spark: SparkSession, root: str) -> DataFrame:
    """Each domain's name with the nearest other one of its category, by edit distance."""
    names = table(spark, root, "domains").select("domain", "category", F.regexp_replace(F.lower(F.col("domain")), r"[^a-z].*$", "").alias("name"))
    return places.closest(names, names.select("category", F.col("domain").alias("other"), F.col("name").alias("other_name")), within=["category"])
