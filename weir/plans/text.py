"""Queries on text, markup and addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.functions import pages as html
from weir.functions.text import cleaned, detected_language, tokens
from weir.plans.registry import literal, query
from weir.session import spread
from weir.sources.tables import table

TOKENS_SQL = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_\\x{0900}-\\x{097F}]+')"
CLEAN_SQL = "trim(regexp_replace(regexp_replace(COLUMN, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f]', ' ', 'g'), '[\\s\\v\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g'))"


@query(f"SELECT doc_id, nfc_normalize({CLEAN_SQL.replace('COLUMN', 'text')}) AS text FROM documents")
def text_normalize(spark: SparkSession, root: str) -> DataFrame:
    """Cleaned in the JVM; only what isn't plain ASCII is composed in Python."""
    text = cleaned(F.col("text"))
    rows = spread(table(spark, root, "documents").select("doc_id", "text")).select("doc_id", text.alias("text"))
    return rows.filter("text IS NULL OR NOT text RLIKE '[^\\\\x00-\\\\x7f]'").unionByName(rows.filter("text RLIKE '[^\\\\x00-\\\\x7f]'").select("doc_id", html.nfc(F.col("text")).alias("text")))


@query(f"SELECT doc_id, len({TOKENS_SQL})::BIGINT AS n, len(list_distinct({TOKENS_SQL}))::BIGINT AS different FROM documents WHERE text IS NOT NULL")
def tokenize(spark: SparkSession, root: str) -> DataFrame:
    found = table(spark, root, "documents").filter("text IS NOT NULL").select("doc_id", tokens(F.col("text")).alias("t"))
    return found.select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("different"))


@query("SELECT doc_id, sha256(text) AS content_hash, 'objects/' || left(sha256(coalesce(url, '')), 32) || '.json' AS object_key FROM documents WHERE text IS NOT NULL")
def content_hash(spark: SparkSession, root: str) -> DataFrame:
    key = F.concat(F.lit("objects/"), F.left(F.sha2(F.coalesce("url", F.lit("")), 256), F.lit(32)), F.lit(".json"))
    return table(spark, root, "documents").filter("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("content_hash"), key.alias("object_key"))


@query(f"SELECT doc_id, {CLEAN_SQL.replace('COLUMN', 'title')} AS title, len({TOKENS_SQL})::BIGINT AS word_count, length(text)::BIGINT AS char_count, sha256(text) AS text_hash, left(text, 20000) AS text FROM documents WHERE text IS NOT NULL")
def doc_record(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", cleaned(F.col("title")).alias("title"), F.size(tokens(F.col("text"))).cast("long").alias("word_count"), F.char_length("text").cast("long").alias("char_count"), F.sha2("text", 256).alias("text_hash"), F.left("text", F.lit(20_000)).alias("text"))


@query("""SELECT doc_id, CASE WHEN length(t) > 240 THEN rtrim(left(t, 237)) || '...' ELSE t END AS snippet FROM (SELECT doc_id, trim(regexp_replace(coalesce(nullif(title, ''), text), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL)""")
def snippet(spark: SparkSession, root: str) -> DataFrame:
    squeezed = F.trim(F.regexp_replace(F.coalesce(F.nullif("title", F.lit("")), "text"), r"\s+", " "))
    rows = table(spark, root, "documents").filter("text IS NOT NULL").select("doc_id", squeezed.alias("t"))
    return rows.select("doc_id", F.when(F.char_length("t") > 240, F.concat(F.rtrim(F.left("t", F.lit(237))), F.lit("..."))).otherwise(F.col("t")).alias("snippet"))


@query("""WITH e AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '(?i)[a-z0-9._%+\\-]+@[a-z0-9.\\-]+\\.[a-z]{2,}'), lambda x: lower(x))) AS email FROM documents)
    SELECT doc_id, email, count(*) AS n FROM e GROUP BY 1, 2""")
def contacts_extract(spark: SparkSession, root: str) -> DataFrame:
    found = table(spark, root, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?i)[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}"), F.lit(0))).alias("email"))
    return found.groupBy("doc_id", F.lower("email").alias("email")).agg(F.count("*").alias("n"))


@query("""SELECT id, phone FROM (SELECT id, unnest(regexp_extract_all(text, '\\+?\\d[\\d\\s().-]{6,}\\d')) AS phone FROM crawled_documents WHERE text IS NOT NULL) WHERE len(regexp_extract_all(phone, '\\d')) >= 7""")
def phones_extract(spark: SparkSession, root: str) -> DataFrame:
    found = table(spark, root, "crawled_documents").select("id", F.explode(F.regexp_extract_all("text", F.lit(r"\+?\d[\d\s().-]{6,}\d"), F.lit(0))).alias("phone"))
    return found.filter(F.regexp_count("phone", F.lit(r"\d")) >= 7)


KEYWORDS = "(1, 'Water, tax , WATER,, Road'), (2, ''), (3, NULL), (4, 'a,b,A,B,c')"


@query(f"""WITH k AS (SELECT id, trim(w) AS w, n FROM (SELECT id, unnest(string_split(words, ',')) AS w, unnest(range(len(string_split(words, ',')))) AS n FROM (VALUES {KEYWORDS}) v(id, words)) WHERE trim(w) <> ''),
    f AS (SELECT id, arg_min(w, n) AS w, min(n) AS n FROM k GROUP BY id, lower(w)) SELECT id, string_agg(w, '|' ORDER BY n) AS words FROM f GROUP BY id""")
def keywords_split(spark: SparkSession, root: str) -> DataFrame:
    """Keywords at commas, the first of those that differ in case only."""
    words = F.filter(F.transform(F.split("words", ","), lambda w: F.trim(w)), lambda w: w != "")
    once = F.aggregate(words, F.array().cast("array<string>"), lambda seen, w: F.when(F.exists(seen, lambda s: F.lower(s) == F.lower(w)), seen).otherwise(F.array_append(seen, w)))
    return literal(spark, KEYWORDS, "t(id, words)").select("id", F.array_join(once, "|").alias("words")).filter("words <> ''")


@query("""SELECT id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)), '^www\\.', '') AS host FROM crawled_documents WHERE url IS NOT NULL""")
def host_extract(spark: SparkSession, root: str) -> DataFrame:
    host = F.regexp_replace(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1)), r"^www\.", "")
    return table(spark, root, "crawled_documents").filter("url IS NOT NULL").select("id", host.alias("host"))


@query("""SELECT id, lower(regexp_extract(url, '\\.([A-Za-z0-9]{1,8})(?:[?#]|$)', 1)) AS extension FROM crawled_documents WHERE url IS NOT NULL""")
def url_extension(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "crawled_documents").filter("url IS NOT NULL").select("id", F.lower(F.regexp_extract("url", r"\.([A-Za-z0-9]{1,8})(?:[?#]|$)", 1)).alias("extension"))


URLS = "(1, 'HTTP://Example.COM:80/a/?b=2&a=1#x'), (2, 'https://x.np:443'), (3, 'https://x.np/p/'), (4, 'https://x.np:8080/p?q='), (5, NULL)"


@query("SELECT * FROM (VALUES (1, 'http://example.com/a?a=1&b=2'), (2, 'https://x.np/'), (3, 'https://x.np/p'), (4, 'https://x.np:8080/p?q='), (5, NULL)) v(id, url)")
def url_canonical(spark: SparkSession, root: str) -> DataFrame:
    return literal(spark, URLS, "t(id, url)").select("id", html.canonical("url").alias("url"))


@query("""SELECT id, link, lower(regexp_extract(link, '://([^/:?#]+)', 1)) = host OR ends_with(lower(regexp_extract(link, '://([^/:?#]+)', 1)), '.' || host) AS internal FROM (SELECT DISTINCT id, host, unnest(links) AS link FROM crawled_documents WHERE host IS NOT NULL)""")
def link_classify(spark: SparkSession, root: str) -> DataFrame:
    """Links to the same host or one below it are internal."""
    links = table(spark, root, "crawled_documents").filter("host IS NOT NULL").select("id", "host", F.explode("links").alias("link")).distinct()
    target = F.lower(F.regexp_extract("link", "://([^/:?#]+)", 1))
    return links.select("id", "link", ((target == F.col("host")) | target.endswith(F.concat(F.lit("."), F.col("host")))).alias("internal"))


HREFS = "('https://x.np/a/b', 'c'), ('https://x.np/a/b', '/d'), ('https://x.np/a/b', '#t'), ('https://x.np/a/b', 'mailto:a@b.np'), ('https://x.np/a/b', 'ftp://x.np'), ('https://x.np/a/b', 'https://y.np/z')"


@query("SELECT * FROM (VALUES ('c', 'https://x.np/a/c'), ('/d', 'https://x.np/d'), ('#t', NULL), ('mailto:a@b.np', NULL), ('ftp://x.np', NULL), ('https://y.np/z', 'https://y.np/z')) v(href, url)")
def link_extract(spark: SparkSession, root: str) -> DataFrame:
    return literal(spark, HREFS, "t(base, href)").select("href", html.resolve("base", "href").alias("url"))


PAGE = "<html><head><title>Water</title><meta name=description content=Tax><link rel=canonical href=https://x.np/a></head><body><nav><a href=/m>Menu</a></nav><h1>Ward 5</h1><p>Water tax &amp; <a href=/t>table</a> for all residents.</p><ul><li>One</li></ul><script>var x = 1</script></body></html>"


@query("SELECT * FROM (VALUES ('Menu Ward 5 Water tax & table for all residents. One', 'Water tax & table for all residents.', 'Water', 'Ward 5', 2, 'https://x.np/a', 1)) v(text, main_text, title, heading, links, canonical, lists)")
def html_extract(spark: SparkSession, root: str) -> DataFrame:
    """All that is wanted of a page's markup out of one parse."""
    found = literal(spark, f"('{PAGE}')", "t(html)").select(html.structure("html").alias("s"))
    return found.select("s.text", "s.main_text", "s.title", F.col("s.headings")[0]["text"].alias("heading"), F.size("s.links").alias("links"), "s.canonical", "s.lists")


@query("SELECT id, unnest(headings).level AS level, unnest(headings).text AS heading FROM crawled_documents")
def html_headings(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "crawled_documents").select("id", F.explode("headings").alias("h")).select("id", "h.level", F.col("h.text").alias("heading"))


SHELLS = "(1, '<div id=root></div><script></script><script></script><script></script>', 0), (2, '<noscript>enable JavaScript</noscript>', 900), (3, '<p>text</p>', 100), (4, '<div id=\"app\"></div>', 10), (5, '<p>x</p>', 5000)"


@query(f"""SELECT id, CASE WHEN html ILIKE '%<noscript%' AND html ILIKE '%javascript%' AND chars < 1500 THEN 'noscript' WHEN chars < 250 AND regexp_matches(html, 'id=.?(root|app|__next)') THEN 'marker'
    WHEN chars < 250 AND len(regexp_extract_all(html, '<script')) >= 3 THEN 'scripts' END AS reason FROM (VALUES {SHELLS}) v(id, html, chars)""")
def needs_render(spark: SparkSession, root: str) -> DataFrame:
    """Why a page must be run to be read."""
    hint = F.col("html").ilike("%<noscript%") & F.col("html").ilike("%javascript%") & (F.col("chars") < 1500)
    short = F.col("chars") < 250
    reason = F.when(hint, "noscript").when(short & F.col("html").rlike("id=.?(root|app|__next)"), "marker").when(short & (F.regexp_count("html", F.lit("<script")) >= 3), "scripts")
    return literal(spark, SHELLS, "t(id, html, chars)").select("id", reason.alias("reason"))


ROMANISED = "'namaste', 'dhanyavad', 'dhanyabad', 'khana', 'pani', 'momo', 'momos', 'chowmein', 'thakali', 'newa', 'sherpa', 'tamang', 'gurung', 'magar', 'limbu', 'tharu', 'nepali'"
ASKED = "(1, '  Water   TAX '), (2, 'खानेपानी'), (3, 'khana pani'), (4, 'ward पानी'), (5, '123'), (6, ''), (7, NULL)"


@query(f"SELECT id, lower(trim(regexp_replace(q, '\\s+', ' ', 'g'))) AS query FROM (VALUES {ASKED}) v(id, q)")
def query_normalize(spark: SparkSession, root: str) -> DataFrame:
    return literal(spark, ASKED, "t(id, q)").select("id", html.normalized_query("q").alias("query"))


@query(f"""WITH n AS (SELECT id, lower(trim(regexp_replace(coalesce(q, ''), '\\s+', ' ', 'g'))) AS q FROM (VALUES {ASKED}) v(id, q))
    SELECT id, CASE WHEN q = '' THEN 'unknown' WHEN regexp_matches(q, '\\p{{Latin}}') AND regexp_matches(q, '[\\x{{0900}}-\\x{{097F}}]') THEN 'mixed' WHEN regexp_matches(q, '[\\x{{0900}}-\\x{{097F}}]') THEN 'ne' WHEN NOT regexp_matches(q, '\\p{{Latin}}') THEN 'unknown'
        WHEN len(list_filter(string_split(q, ' '), lambda w: w NOT IN ({ROMANISED}))) = 0 THEN 'ne' ELSE 'en' END AS language FROM n""")
def query_language(spark: SparkSession, root: str) -> DataFrame:
    q = F.col("query")
    latin, deva = q.rlike(r"\p{IsLatin}"), q.rlike(r"[\x{0900}-\x{097F}]")
    known = F.forall(F.split("query", " "), lambda w: w.isin(*[x.strip(" '") for x in ROMANISED.split(",")]))
    language = F.when(q == "", "unknown").when(latin & deva, "mixed").when(deva, "ne").when(~latin, "unknown").when(known, "ne").otherwise("en")
    return literal(spark, ASKED, "t(id, q)").select("id", F.coalesce(html.normalized_query("q"), F.lit("")).alias("query")).select("id", language.alias("language"))


#: Names of places in both scripts.
PLACES = "('pokhara', 'पोखरा'), ('kusma', 'कुश्मा'), ('lumbini park', 'लुम्बिनी उद्यान')"
QUERIES = "(1, 'Pokhara  roads'), (2, 'पोखरा'), (3, 'road'), (4, 'kusma pokhara maps taxes'), (5, 'lumbini park'), (6, 'खानेपानी'), (7, '')"


@query(f"""WITH q AS (SELECT id, lower(trim(regexp_replace(q, '\\s+', ' ', 'g'))) AS q FROM (VALUES {QUERIES}) v(id, q)), p AS (SELECT * FROM (VALUES {PLACES}) v(en, ne)), both_ways AS (SELECT en AS a, ne AS b FROM p UNION ALL SELECT ne, en FROM p),
    w AS (SELECT id, q, unnest(string_split(q, ' ')) AS w, unnest(range(len(string_split(q, ' ')))) AS n FROM q),
    s AS (SELECT id, q, string_agg(CASE WHEN regexp_matches(w, '[^s]s$') THEN CASE WHEN w LIKE '%es' AND w NOT LIKE '%oses' THEN left(w, -2) ELSE left(w, -1) END ELSE w END, ' ' ORDER BY n) AS lemma FROM w GROUP BY id, q),
    t AS (SELECT id, 0 AS k, q AS term FROM s UNION ALL SELECT id, 1, lemma FROM s WHERE lemma <> '' UNION ALL SELECT id, 2, b FROM s JOIN both_ways ON a = q UNION ALL SELECT id, 3, b FROM s JOIN both_ways ON a = lemma UNION ALL SELECT id, 4 + n, b FROM w JOIN both_ways ON a = w),
    f AS (SELECT id, term, min(k) AS k FROM t WHERE term <> '' GROUP BY id, term), o AS (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY k) AS r FROM f)
    SELECT q.id, coalesce(string_agg(term, '|' ORDER BY r) FILTER (WHERE r <= 4), '') AS variants FROM q LEFT JOIN o USING (id) GROUP BY q.id""")
def query_expand(spark: SparkSession, root: str) -> DataFrame:
    """A query, its stems, and the other spelling of its places (the whole query, its stems, its words), each once, at most four."""
    given = literal(spark, QUERIES, "t(id, q)").select("id", html.normalized_query("q").alias("q"))
    pairs = literal(spark, PLACES, "t(en, ne)").select(F.explode(F.array(F.struct(F.col("en").alias("key"), F.col("ne").alias("value")), F.struct(F.col("ne").alias("key"), F.col("en").alias("value")))).alias("e"))
    return html.expanded(given, pairs.agg(F.map_from_entries(F.collect_list("e")).alias("places"))).select("id", F.array_join("variants", "|").alias("variants"))


CODES = "(1, 'en-US'), (2, 'ne_NP'), (3, 'FR'), (4, NULL), (5, '')"


@query(f"SELECT id, CASE lower(regexp_extract(coalesce(code, ''), '^[A-Za-z]*')) WHEN 'en' THEN 'EN' WHEN 'ne' THEN 'NE' WHEN 'hi' THEN 'HI' WHEN '' THEN NULL ELSE 'OTHER' END AS language FROM (VALUES {CODES}) v(id, code)")
def language_map(spark: SparkSession, root: str) -> DataFrame:
    head = F.lower(F.regexp_extract(F.coalesce("code", F.lit("")), "^[A-Za-z]*", 0))
    known = F.create_map(*map(F.lit, ("en", "EN", "ne", "NE", "hi", "HI")))
    return literal(spark, CODES, "t(id, code)").select("id", F.when(head != "", F.coalesce(known[head], F.lit("OTHER"))).alias("language"))


DATES = "(1, '2024-01-02T03:04:05Z', NULL, NULL), (2, 'soon', '2024-05-06', NULL), (3, NULL, NULL, '2024-07-08 09:10:11'), (4, NULL, '', NULL)"


@query(f"SELECT id, coalesce(try_cast(replace(replace(a, 'T', ' '), 'Z', '') AS TIMESTAMP), try_cast(b AS TIMESTAMP), try_cast(c AS TIMESTAMP)) AS published_at FROM (VALUES {DATES}) v(id, a, b, c)")
def published_at(spark: SparkSession, root: str) -> DataFrame:
    return literal(spark, DATES, "t(id, a, b, c)").select("id", F.coalesce(*[F.col(x).try_cast("timestamp") for x in "abc"]).alias("published_at"))


@query()
def simhash_fnv(spark: SparkSession, root: str) -> DataFrame:
    """The crawler's own fingerprint, over case-sensitive words."""
    return table(spark, root, "documents").select("doc_id", html.fnv_simhash("text").alias("simhash"))


@query()
def stem(spark: SparkSession, root: str) -> DataFrame:
    """How often each stem stands in the documents; each different word is stemmed once."""
    words = table(spark, root, "documents").select(F.explode(tokens(F.col("text"))).alias("w")).groupBy("w").count()
    stemmed = words.withColumn("stem", html.stems(F.array("w"))[0])
    return stemmed.groupBy("stem").agg(F.sum("count").alias("n"), F.count("*").alias("words"))


@query()
def lemma_counts(spark: SparkSession, root: str) -> DataFrame:
    """How often each Nepali word stands without its ending."""
    words = table(spark, root, "documents").filter(detected_language(F.col("text")) == "ne").select(F.explode(tokens(F.col("text"))).alias("w")).groupBy("w").count()
    return words.withColumn("lemma", html.lemmas(F.array("w"))[0]).groupBy("lemma").agg(F.sum("count").alias("n"))


@query(f"""WITH t AS (SELECT doc_id, {TOKENS_SQL} AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id, least(16, greatest(1, ceil(len(w) / 256.0)))::BIGINT AS windows FROM t""")
def text_windows(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").filter("text IS NOT NULL").select("doc_id", tokens(F.col("text")).alias("w")).select("doc_id", F.size(html.windows(F.col("w"))).cast("long").alias("windows"))


@query("SELECT * FROM (VALUES (1, 'café'), (2, 'café'), (3, 'caf�')) v(id, text)")
def html_decode(spark: SparkSession, root: str) -> DataFrame:
    given = literal(spark, "(1, X'636166C3A9', NULL), (2, X'636166E9', 'text/html; charset=ISO-8859-1'), (3, X'636166E9', 'text/html')", "t(id, content, kind)")
    return given.select("id", html.decoded("content", "kind").alias("text"))
