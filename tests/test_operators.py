"""Operators on small fixtures: nulls, ties, empty tables, and brute force where SQL has no say."""

import itertools
import random

import duckdb  # noqa: F401
from pyspark.sql import functions as F

from weir.functions import pages as html
from weir.functions.text import detected_language, tokens
from weir.operators import ann, frontier, keyed, near, places, rank, search


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_latest_ties_nulls_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "a", 5, "x"), (2, "a", 5, "y"), (3, None, 9, "z"), (4, "b", None, "w")], "id long, k string, at int, __extra string")
    assert rows(keyed.latest(df, ["k"], [F.desc_nulls_last("at"), F.desc("id")]), "id", "__extra") == [(2, "y"), (4, "w")]
    assert keyed.latest(df.limit(0), ["k"], [F.desc("id")]).count() == 0


def test_versions(spark):
    df = spark.createDataFrame([(1, "u", "h1", 1), (2, "u", "h1", 2), (3, "u", "h2", 3), (4, "u", None, 4), (5, "v", None, 1)], "id long, k string, h string, at int")
    assert rows(keyed.versions(df, "k", "h", [F.asc("at"), F.asc("id")]), "id", "version", "content_changed") == [(1, 1, True), (2, 1, False), (3, 2, True), (4, 3, True), (5, 1, True)]


def test_upsert_is_idempotent_and_guarded(spark):
    t = spark.createDataFrame([(1, "a", 5), (2, "b", 7)], "v long, k string, id int")
    s = spark.createDataFrame([(9, "a", 4), (8, "b", 8), (7, "c", 1), (6, "c", 2)], "v long, k string, id int")
    once = keyed.upsert(t, s, ["k"], [F.desc("id")], guard="t.id <= s.id")
    assert rows(once, "k", "v", "inserted", "updated") == [("a", 1, False, False), ("b", 8, False, True), ("c", 6, True, False)]
    again = keyed.upsert(once.drop("inserted", "updated"), s, ["k"], [F.desc("id")], guard="t.id <= s.id")
    assert rows(again, "k", "v") == rows(once, "k", "v")


def test_duplicates_claims_and_mode(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, None), (5, "y")], "id long, h string")
    assert rows(keyed.exact_duplicates(df, "h", "id"), "id", "duplicate_of") == [(1, None), (2, 1), (3, None), (4, None), (5, None)]
    q = spark.createDataFrame([(1, 3, "UNPROCESSED"), (2, 1, "UNPROCESSED"), (3, 1, "PROCESSED")], "id long, at int, status string")
    assert rows(keyed.claim(q, 1, [F.asc("at"), F.asc("id")]), "id", "status") == [(1, "UNPROCESSED"), (2, "PROCESSING"), (3, "PROCESSED")]
    m = spark.createDataFrame([("g", "b", 1), ("g", "a", 2), ("g", "b", 1), ("g", None, 3)], "g string, v string, u int")
    assert rows(keyed.mode(m, "g", "v", "u"), "g", "v", "uses") == [("g", "a", 1)]


def test_near_pairs_lose_none(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(12)]
    values = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(5))) for b in base for _ in range(4)]
    values = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame(list(enumerate(values)) + [(100, values[0]), (101, values[0])], "id long, h long")
    distinct = {}
    for k, v in enumerate(values):
        distinct.setdefault(v, k)
    wanted = sorted((a, b, bin((x ^ y) & (2**64 - 1)).count("1")) for (x, a), (y, b) in itertools.combinations(distinct.items(), 2) if bin((x ^ y) & (2**64 - 1)).count("1") <= 3)
    assert rows(near.near_pairs(df, "id", "h"), "a", "b", "distance") == sorted((min(a, b), max(a, b), d) for a, b, d in wanted)
    classes = {r["id"]: r["class"] for r in near.classes(df, "id", "h").collect()}
    assert classes[100] == classes[101] == classes[0] and len(classes) == len(values) + 2


def test_near_pairs_broadcast_no_choices_of_blocks(spark):
    df = spark.range(500).select("id", F.xxhash64("id").alias("h"))
    assert "BroadcastHashJoin" not in near.near_pairs(df, "id", "h")._jdf.queryExecution().executedPlan().toString()


def test_search_over_fields_with_nulls_misspelt_words_and_no_hits(spark):
    docs = spark.createDataFrame([(1, "Water board", "the water is clean"), (2, None, "bored of watter"), (3, "", None), (4, "School", "meals meals"), (5, "x", "water " * 5000)], "id long, title string, text string")
    index = search.Index(docs, "id", ["title", "text"])
    got = {r["id"]: r["score"] for r in index.search(spark, ["water bord", "nothing"], {"title": 3.0, "text": 1.0}).collect()}
    assert set(got) == {1, 2, 5} and got[1] > got[5] > 0
    assert search.Index(docs.limit(0), "id", ["title", "text"]).search(spark, ["water"], {"title": 1.0, "text": 1.0}).count() == 0


def test_merged_candidates_features_and_stable_order(spark):
    a = spark.createDataFrame([(1, 2.0, None), (2, None, "")], "id long, bm25_score double, title string")
    b = spark.createDataFrame([(1, 0.5, "t"), (3, 0.1, "u")], "id long, vector_score double, title string")
    got = {r["id"]: (r["bm25_score"], r["vector_score"], r["title"], r["sources"]) for r in search.merged({"lexical": a, "dense": b}, "id", ["bm25_score", "vector_score"], ["title"]).collect()}
    assert got == {1: (2.0, 0.5, "t", ["dense", "lexical"]), 2: (0.0, 0.0, None, ["lexical"]), 3: (0.0, 0.1, "u", ["dense"])}
    rows_ = spark.createDataFrame([(1, "Water plan", None, "en", None, float("nan"), None, None, 1), (2, None, "water", None, None, 1.0, float("inf"), 7, 2), (3, None, None, "en", None, None, None, None, 3)], "id long, title string, text string, language string, published_at timestamp_ntz, bm25_score double, vector_score double, content_length long, before int")
    now = F.lit("2024-01-01").cast("timestamp_ntz")
    made = {r["id"]: r for r in search.with_features(rows_, "water plan", "en", now).collect()}
    assert (made[1]["f_bm25_score"], made[1]["f_query_term_ratio"], made[1]["f_title_match"], made[2]["f_vector_score"], made[2]["f_query_term_ratio"], made[3]["f_freshness"]) == (0.0, 1.0, 1.0, 0.0, 0.5, 0.0)
    same = search.reranked(search.with_features(rows_, "water plan", None, now), "id", lambda f: f["language_match"], "before")
    assert rows(same, "id", "place") == [(1, 1), (2, 2), (3, 3)]


def test_state_of_queues_quarantine_maps_and_clicks(spark):
    q = spark.createDataFrame([(1, "PROCESSING"), (2, "PROCESSING"), (3, "UNPROCESSED"), (4, "PROCESSING")], "id long, status string")
    r = spark.createDataFrame([(1, None), (2, "bad"), (3, "bad"), (2, None)], "id long, error string")
    assert rows(keyed.finished(q, r), "id", "status", "error") == [(1, "PROCESSED", None), (2, "FAILED", "bad"), (3, "UNPROCESSED", None), (4, "PROCESSING", None)]
    bad = spark.createDataFrame([(1, "s"), (2, "s"), (3, None)], "id long, sig string")
    records, parked, kept = keyed.quarantined(bad, "sig", spark.createDataFrame([(2,), (9,), (9,)], "id long"), "id")
    assert rows(records, "sig", "id", "times") == [("s", 2, 2)] and parked.count() == 3 and rows(kept, "id") == [(9,), (9,)]
    assert {x["g"]: x["v"] for x in keyed.count_maps(spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "g int, v string"), ["g"], "v").collect()} == {1: {"a": 2, "b": 1}}
    asked = spark.sql("SELECT * FROM VALUES (1, 7, TIMESTAMP_NTZ'2024-01-01 00:00:00'), (2, 7, TIMESTAMP_NTZ'2024-01-01 00:29:00'), (3, 8, TIMESTAMP_NTZ'2024-01-01 00:00:00') AS t(id, k, at)")
    clicks = spark.sql("SELECT * FROM VALUES (7, TIMESTAMP_NTZ'2024-01-01 00:29:59'), (7, TIMESTAMP_NTZ'2024-01-01 00:30:00'), (9, TIMESTAMP_NTZ'2024-01-01 00:00:00') AS t(k, then)")
    assert rows(keyed.followed(asked, clicks, "id", "k", "at", "then", 1800), "id", "n") == [(1, 1), (2, 2), (3, 0)]
    assert keyed.followed(asked.limit(0), clicks, "id", "k", "at", "then", 1800).count() == 0


def test_folding_is_that_of_rows_in_order(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(6)]
    made = []
    for k in range(160):
        h = rng.choice(base)
        for _ in range(rng.randrange(4)):
            h ^= 1 << rng.choice([1, 5, 9, 14, 33, 40])
        made.append((k, h - (1 << 64) if h >> 63 else h, f"t{h % 1000}{rng.randrange(2)}"))
    made += [(200, 0, "e"), (201, 0, "e"), (202, 0, None), (203, 0, None)]
    wanted, stands = {}, []
    for k, h, content in made:
        same = [j for j, _, c in stands if c == content and c is not None]
        close = sorted((bin((h ^ g) & (2**64 - 1)).count("1"), j) for j, g, _ in stands if h and g)
        to = min(same) if same else next((j for d, j in close if d <= 3), None)
        wanted[k] = to
        if to is None:
            stands.append((k, h, content))
    df = spark.createDataFrame(made, "id long, h long, content string")
    assert {r["id"]: r["duplicate_of"] for r in near.folded(df, "id", "h", "content").collect()} == wanted
    assert near.folded(df.limit(0), "id", "h", "content").count() == 0


def test_simhash_of_nulls_and_long_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "water board"), (4, "board water"), (5, "ward " * 30_000)], "id long, text string")
    got = {r["id"]: r["simhash"] for r in near.simhash(df, "id", "text").collect()}
    assert got[1] == got[2] == 0 and got[3] == got[4] != 0 and got[5] != 0


def test_numbering_and_closest_names(spark):
    df = spark.createDataFrame([(k, k * 7 % 50) for k in range(200)], "id long, v long")
    got = [r["id"] for r in keyed.numbered(df, [F.desc("v"), F.asc("id")], "n").orderBy("n").collect()]
    assert got == [k for k, _ in sorted(((k, k * 7 % 50) for k in range(200)), key=lambda x: (-x[1], x[0]))]
    rng = random.Random(2)
    names = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 9))) for _ in range(120)]
    a = spark.createDataFrame([(f"d{k:03}", n) for k, n in enumerate(names)], "domain string, name string")
    b = a.select(F.col("domain").alias("other"), F.col("name").alias("other_name"))

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row = [i, *itertools.accumulate(range(1, len(y) + 1), lambda left, j, row=row, c=c: min(left + 1, row[j] + 1, row[j - 1] + (c != y[j - 1])), initial=i)][1:]
        return row[-1]

    wanted = {}
    for k, x in enumerate(names):
        ratios = [(1 - distance(x, y) / max(len(x), len(y)), f"d{j:03}") for j, y in enumerate(names) if j != k and x and y]
        if ratios and max(ratios)[0] >= 0.75:
            wanted[f"d{k:03}"] = (max(ratios)[1], round(max(ratios)[0], 6))
    assert {r["domain"]: (r["other"], r["ratio"]) for r in places.closest(a, b).collect()} == wanted


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 6), (6, 9), (3, 1)], "a long, b long")
    assert rows(near.components(edges), "node", "class") == [(1, 1), (2, 1), (3, 1), (6, 6), (7, 6), (9, 6)] or {n: c for n, c in rows(near.components(edges), "node", "class")} == {2: 1, 3: 1, 7: 6, 9: 6}


def test_pagerank(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,), (4,)], "node long")
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 3), (9, 1)], "src long, dst long")
    got = {r["node"]: r["rank"] for r in rank.pagerank(nodes, links, 100, 1e-8).collect()}
    ranks, out = {n: 0.25 for n in (1, 2, 3, 4)}, {1: [2, 3], 2: [3], 3: [1]}
    for _ in range(100):
        lost = ranks[4]
        ranks = {n: 0.15 / 4 + 0.85 * lost / 4 + 0.85 * sum(ranks[s] / len(d) for s, d in out.items() if n in d) for n in ranks}
    assert all(abs(got[n] - ranks[n]) < 1e-6 for n in ranks) and abs(sum(got.values()) - 1) < 1e-6
    assert rank.pagerank(nodes.limit(0), links).count() == 0


def test_search_on_nulls_and_fusion(spark):
    docs = spark.createDataFrame([(1, "water board water"), (2, None), (3, ""), (4, "board"), (5, "road")], "id long, text string")
    assert [r["id"] for r in rank.bm25(docs, "id", "text", ["water", "board"]).orderBy(F.desc("score")).collect()] == [1, 4]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0]), (5, [1.0])], "id long, e array<float>")
    assert [r["id"] for r in rank.nearest(v, "id", "e", [1.0, 0.0], 5).collect()] == [1, 4]


def test_ann_recall(spark):
    import numpy as np

    x = np.random.default_rng(1).standard_normal((300, 8))
    df = spark.createDataFrame([(k, [float(a) for a in row]) for k, row in enumerate(x)], "id long, embedding array<float>")
    got = ann.nearest_by_planes(df, df.filter("id % 10 = 0"), 5).collect()
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 300, 10):
        best = [k for k in np.argsort(-(n @ n[q])) if k != q][:5]
        hit += len({r["neighbour"] for r in got if r["id"] == q} & set(best))
    assert hit / 150 >= 0.9


def test_robots():
    body = "User-agent: a\nUser-agent: b\nDisallow: /x # no\nAllow: /x/y\n\nUser-agent: *\nDisallow: /\nDisallow:\n"
    assert frontier.parse_robots(body, "B") == [("/x", False), ("/x/y", True)]
    assert frontier.parse_robots(body, "c") == [("/", False)]
    assert frontier.parse_robots("", "c") == []


def test_html_and_words():
    page = html.record("<p>a<script>x</script> b &amp; c</p><nav>menu</nav>")
    assert page["text"] == "a b & c menu" and page["tags"]["p"] == 1
    assert html.record(None) is None and html.record("")["text"] == ""
    stems = {"caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "happy": "happi", "adjustment": "adjust", "sky": "sky", "controlling": "control", "generalizations": "gener"}
    assert {w: html.Porter.stem(w) for w in stems} == stems
    assert html.nepali_lemma("विद्यार्थीहरूलाई") == "विद्यार्थी"
    assert html.canonical_url("HTTP://A.np:80/x/?b=1&a=2#f") == "http://a.np/x?a=2&b=1" and html.canonical_url(None) is None
    assert html.decode_bytes(b"\xe9", None) == "�" and html.fnv1a("") == 0xCBF29CE484222325
    assert list(html.sitemap_urls(None)) == []


def test_text_expressions(spark):
    df = spark.createDataFrame([("विद्यार्थी has ½ a_b",), (None,), ("",), ("café 12",)], "t string")
    assert [r[0] for r in df.select(tokens(F.col("t"))).collect()] == [["विद्यार्थी", "has", "½", "a_b"], None, [], ["café", "12"]]
    assert [r[0] for r in df.select(detected_language(F.col("t"))).collect()] == ["mixed", "unknown", "unknown", "en"]


def test_places_on_empty(spark):
    none = spark.createDataFrame([], "id long, x double, y double")
    ring = spark.sql("SELECT 'A' AS code, array(named_struct('x', 0D, 'y', 0D), named_struct('x', 1D, 'y', 0D), named_struct('x', 0D, 'y', 1D)) AS ring")
    assert places.locate(none, ring).count() == 0
    assert places.locate(spark.createDataFrame([(1, 0.5, 0.5), (2, 0.6, 0.6), (3, None, 0.1)], none.schema), ring).collect()[0]["id"] == 1


def test_pagerank_takes_all_links_to_the_tolerance(spark, tmp_path):
    from weir.plans.registry import QUERIES

    n, rows = 9, [(1 + k % 8, 1 + (k * k + k // 5) % 40, 1 + k % 6) for k in range(30)]  # supplier 9 has no rows
    spark.createDataFrame([(k, k % 3) for k in range(1, n + 1)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_linenumber int").selectExpr("*", "timestamp'2020-01-01' AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    links = {(s, 1 + p % n) for s, p, _ in rows if s != 1 + p % n}
    ranks = dict.fromkeys(range(1, n + 1), 1 / n)
    for _ in range(300):
        lost = sum(r for k, r in ranks.items() if not any(s == k for s, _ in links))
        ranks = {k: (0.15 + 0.85 * lost) / n + 0.85 * sum(ranks[s] / sum(x == s for x, _ in links) for s, d in links if d == k) for k in ranks}
    got = {r["node"]: r["rank"] for r in QUERIES["pagerank"](spark, str(tmp_path)).collect()}
    assert got.keys() == ranks.keys() and sum(abs(got[k] - ranks[k]) for k in ranks) < 1e-6
