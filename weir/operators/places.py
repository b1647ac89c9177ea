"""Places: names to codes, points to polygons, polygons beside each other, countries and coordinates of pages.

Null names and points outside every polygon have no code; ambiguous names have none either.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that say what kind of place a name is, the longer first.
KINDS = (
    "sub-metropolitan city", "submetropolitan city", "metropolitan city", "rural municipality", "municipality", "upamahanagarpalika", "mahanagarpalika", "nagarpalika", "gaunpalika", "gaupalika", "province", "district",
    "उपमहानगरपालिका", "महानगरपालिका", "नगरपालिका", "गाउँपालिका", "प्रदेश", "जिल्ला",
)
# Country names and top-level domains.
COUNTRIES = {"nepal": "NP", "india": "IN", "bhutan": "BT", "bangladesh": "BD", "pakistan": "PK", "china": "CN", "sri lanka": "LK", "united kingdom": "GB", "united states": "US"}
DOMAINS = {"np": "NP", "in": "IN", "bt": "BT", "bd": "BD", "pk": "PK", "cn": "CN", "lk": "LK", "uk": "GB", "us": "US"}
#: Side of a grid cell in degrees; radius of the earth in kilometres; how far apart two corners may be and count as one.
CELL, RADIUS, TOLERANCE = 0.25, 6378.137, 0.002


def place_key(name: Column) -> Column:
    """A name without the words for its kind, blanks and punctuation."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "(" + "|".join(KINDS) + ")", ""), r"[\s_.,'’()/-]", "")


def resolve(names: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(id, code) of names (id, name) by a gazetteer (en, ne, code), which is a small dimension."""
    wanted = names.select("id", place_key(F.col("name")).alias("k"))
    known = gazetteer.select("code", place_key(F.col("en")).alias("e"), place_key(F.col("ne")).alias("d"))
    only = lambda found, name: found.groupBy("id").agg(F.min("code").alias(name), F.count_distinct("code").alias("n")).filter("n = 1").drop("n")
    exact = only(wanted.join(known.select("code", F.explode(F.array_distinct(F.array("e", "d"))).alias("k")), "k"), "exact")
    # a common beginning: the shorter key is a prefix of the longer, so prefixes of both are joined by equality
    prefixes = lambda key: F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(key), F.lit(1))), lambda n: F.substring(key, F.lit(1), n)))
    longer = wanted.filter("k <> ''").select("id", prefixes(F.col("k")).alias("e")).join(known.select("code", "e"), "e").select("id", "code")
    shorter = known.filter("e <> ''").select("code", prefixes(F.col("e")).alias("k")).join(wanted, "k").select("id", "code")
    alike = only(longer.unionByName(shorter).distinct(), "alike")
    return wanted.select("id").join(exact, "id", "left").join(alike, "id", "left").select("id", F.coalesce("exact", "alike").alias("code"))


def edges_of(ring: Column) -> Column:
    """A ring's corners, each with the next."""
    return F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1)), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is within a ring or on its edge."""
    edges = edges_of(ring)
    on = F.exists(edges, lambda e: (((e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])) == 0) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])))
    crossings = F.size(F.filter(edges, lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])))
    return on | (crossings % 2 == 1)


def locate(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """(id, code) of the points (id, x, y) in a polygon (code, ring): joined by grid cells, then tested exactly."""
    cell = lambda v: F.floor(v / CELL)
    span = lambda axis: F.explode(F.sequence(cell(F.array_min(F.transform("ring", lambda p: p[axis]))), cell(F.array_max(F.transform("ring", lambda p: p[axis])))))
    cells = polygons.withColumn("cx", span("x")).withColumn("cy", span("y"))
    placed = points.withColumn("cx", cell(F.col("x"))).withColumn("cy", cell(F.col("y")))
    found = placed.join(cells, ["cx", "cy"]).filter(inside(F.col("x"), F.col("y"), F.col("ring")))
    return found.groupBy("id").agg(F.min("code").alias("code"))


def adjacent(polygons: DataFrame) -> DataFrame:
    """(a, b, shared): polygons with at least two corners in common, a < b. A corner meets those of the cells around its own."""
    size = 5 * TOLERANCE
    corners = polygons.select("code", F.explode("ring").alias("p")).select("code", "p.x", "p.y").distinct()
    own = corners.select(F.col("code").alias("a"), "x", "y", F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy"))
    around = corners.select(F.col("code").alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    near = lambda c, v: F.explode(F.array(*[F.floor(F.col(v) / size) + k for k in (-1, 0, 1)])).alias(c)
    around = around.select("*", near("cx", "x2")).select("*", near("cy", "y2"))
    met = own.join(around, ["cx", "cy"]).filter((F.col("a") < F.col("b")) & (F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")) <= TOLERANCE))
    return met.select("a", "b", "x", "y").distinct().groupBy("a", "b").agg(F.count("*").alias("shared")).filter("shared >= 2")


def areas(polygons: DataFrame) -> DataFrame:
    """(code, area): the area of rings of degrees on the sphere."""
    rad = math.pi / 180
    term = F.aggregate(edges_of(F.col("ring")), F.lit(0.0), lambda s, e: s + (e["x2"] - e["x1"]) * rad * (2 + F.sin(e["y1"] * rad) + F.sin(e["y2"] * rad)))
    return polygons.select("code", (F.abs(term) * RADIUS * RADIUS / 2).alias("area"))


def country(pages: DataFrame) -> DataFrame:
    """Pages (address, locale, region, lang, host) with `country` by the first signal that tells it."""
    # two letters are a code, longer ones a name of the list
    code = lambda c: F.when(F.char_length(F.trim(c)) == 2, F.upper(F.trim(c))).otherwise(lookup(COUNTRIES, F.lower(F.trim(c))))
    lookup = lambda table, key: F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]
    parts = lambda c: F.filter(F.split(c, "[-_]"), lambda x: x != "")
    territory = lambda c: F.when(F.size(parts(c)) >= 2, code(F.element_at(parts(c), -1)))
    region = F.when(F.col("region").rlike("^.[^-_]*[-_]"), F.regexp_extract("region", "^(.[^-_]*)[-_]", 1)).otherwise(F.col("region"))
    spoken = F.when(F.lower(F.element_at(F.split("lang", "-"), 1)) == "ne", "NP")
    domain = lookup(DOMAINS, F.lower(F.element_at(F.split(F.regexp_replace("host", r"\.$", ""), r"\."), -1)))
    signals = [code(F.col("address")), territory(F.col("locale")), code(region), territory(F.col("lang")), spoken, domain]
    return pages.withColumn("country", F.coalesce(*signals))


def coordinates(metas: DataFrame) -> DataFrame:
    """(id, lat, lng) by `position` (lat;lng), else by `icbm` (lat, lng); pairs out of range are none."""

    def pair(column: str, mark: str) -> Column:
        lat, lng = (F.trim(F.split_part(F.col(column), F.lit(mark), F.lit(k))).try_cast("double") for k in (1, 2))
        return F.when(lat.between(-90, 90) & lng.between(-180, 180), F.struct(lat.alias("lat"), lng.alias("lng")))

    return metas.select("id", F.coalesce(pair("position", ";"), pair("icbm", ",")).alias("p")).select("id", "p.lat", "p.lng")


def grams_of(name: Column) -> Column:
    """Pairs of letters of a name with its ends marked; the second and later ones of a kind are numbered."""
    padded = F.concat(F.lit("^"), name, F.lit("$"))
    pairs = F.transform(F.sequence(F.lit(1), F.char_length(padded) - 1), lambda k: F.substring(padded, k, F.lit(2)))
    return F.transform(pairs, lambda x, k: F.concat(x, F.size(F.filter(F.slice(pairs, 1, k + 1), lambda y: y == x)).cast("string")))


def closest(names: DataFrame, others: DataFrame, least: float = 0.75, within: list[str] | None = None) -> DataFrame:
    """(domain, other, ratio): for each name (domain, name) the most similar of the other ones (other, other_name), in the same group if columns are given.

    Similarity is one less the edit distance's share of the longer name. An edit touches two pairs of letters, so names that
    are similar enough share one of the rarest pairs of both: only those are compared, and no pair is lost. Names that differ
    in nothing are compared once. Null and empty names have no match; ties go to the greater `other`.
    """
    group = within or []
    left = names.filter("name <> ''").withColumn("__g", grams_of(F.col("name")))
    right = others.filter("other_name <> ''").withColumn("__g", grams_of(F.col("other_name")))
    last = right.groupBy(*group, "other_name", "__g").agg(F.max("other").alias("last"))
    second = right.drop("__g").join(last.drop("__g"), [*group, "other_name"]).filter("other < last").groupBy(*group, "other_name").agg(F.max("other").alias("second"))
    heads = last.join(second, [*group, "other_name"], "left")
    every = left.select(*group, "name", "__g").unionByName(heads.select(*group, F.col("other_name").alias("name"), "__g")).distinct()
    rare = every.select(*group, F.explode("__g").alias("gram")).groupBy(*group, "gram").agg(F.count("*").alias("n"))

    def rarest(df: DataFrame, name: str) -> DataFrame:
        most = F.floor((1 - least) / least * F.char_length(name)) * 2 + 1  # the other name is at most so much longer
        sorted_grams = df.select(*group, name, F.explode("__g").alias("gram")).join(rare, [*group, "gram"]).groupBy(*group, name).agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("g"))
        return sorted_grams.select(*group, name, F.explode(F.slice("g", F.lit(1), most.cast("int"))).alias("s")).select(*group, name, "s.gram")

    pairs = rarest(left.select(*group, "name", "__g").distinct(), "name").join(rarest(heads, "other_name"), [*group, "gram"]).select(*group, "name", "other_name").distinct()
    ratio = 1 - F.levenshtein("name", "other_name") / F.greatest(F.char_length("name"), F.char_length("other_name"))
    alike = pairs.withColumn("ratio", ratio).filter(F.col("ratio") >= least).join(heads.drop("__g"), [*group, "other_name"])
    met = left.drop("__g").join(alike, [*group, "name"]).withColumn("other", F.when(F.col("last") != F.col("domain"), F.col("last")).otherwise(F.col("second"))).filter("other IS NOT NULL")
    return met.groupBy("domain").agg(F.max_by(F.struct("other", "ratio"), F.struct("ratio", "other")).alias("best")).select("domain", "best.other", F.round("best.ratio", 6).alias("ratio"))
