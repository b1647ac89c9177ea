"""Crawl operators: robots rules, seeds, frontier selection, breadth-first rounds, outcomes and validation of events and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weir.session import cut

# File name endings that are refused, and those that are expected.
SUSPICIOUS = "exe bat cmd com scr msi vbs js jar ps1 sh".split()
EXPECTED = "html htm pdf txt json png jpg jpeg gif docx csv".split()
MOST_BYTES, LONGEST_NAME = 10 * 1024 * 1024, 100


def rule_pattern(rule: Column) -> Column:
    """A robots rule as a regular expression: `*` is anything, `$` at the end the end."""
    escaped = F.regexp_replace(rule, r"([.+?^(){}\[\]|\\])", r"\\$1")
    starred = F.regexp_replace(escaped, r"\*", ".*")
    ends = starred.endswith("$")
    return F.concat(F.lit("^"), F.when(ends, starred).otherwise(F.regexp_replace(starred, r"\$", r"\\\$")))


def allowed(targets: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, allowed) of targets (id, host, path) by rules (host, rule, allow): the longest rule that fits wins, allowing at a tie."""
    filled = rules.filter("rule <> ''").withColumn("pattern", rule_pattern(F.col("rule")))
    fits = targets.join(filled, "host").filter(F.expr("path RLIKE pattern"))
    best = fits.groupBy("id").agg(F.max_by("allow", F.struct(F.char_length("rule"), F.col("allow"))).alias("allow"))
    return targets.select("id").join(best, "id", "left").select("id", F.coalesce("allow", F.lit(True)).alias("allowed"))


def parse_robots(body: str, agent: str) -> list[tuple[str, bool]]:
    """(rule, allow) of all groups that name the agent, else of those for everyone. Lines of several agents share a group."""
    groups: list[tuple[set[str], list[tuple[str, bool]]]] = []
    fresh = False
    for line in body.splitlines():
        name, colon, value = line.split("#")[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name == "user-agent":
            if not fresh:
                groups.append((set(), []))
            groups[-1][0].add(value.lower())
            fresh = True
        elif name in ("allow", "disallow") and groups:
            fresh = False
            if value:
                groups[-1][1].append((value, name == "allow"))
        elif groups:
            fresh = False
    own = [rules for names, rules in groups if agent.lower() in names] or [rules for names, rules in groups if "*" in names]
    return [rule for rules in own for rule in rules]


def forward_filled(lines: DataFrame) -> DataFrame:
    """Seed lines (n, line) with the section and priority above them; comments and blank lines are left out."""
    # a list of seeds is one small file whose order is its meaning
    above = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    head = F.regexp_extract("line", r"^\[([^\]]*)\]", 1)
    section = F.last(F.when(head != "", head), ignorenulls=True).over(above)
    named = lines.withColumn("line", F.trim(F.regexp_replace("line", "#.*$", ""))).withColumn("section", section)
    kept = named.filter("line <> '' AND NOT line LIKE '[%'")
    parts, words = F.split("section", r"\s+"), F.split("line", r"\s+")
    return kept.select("n", words[0].alias("url"), parts[0].alias("category"), F.coalesce(F.get(words, F.lit(1)).try_cast("int"), F.get(parts, F.lit(1)).try_cast("int"), F.lit(0)).alias("priority"))


def select_frontier(frontier: DataFrame, per_host: int, budget: int) -> DataFrame:
    """The next items: highest priority first, then the longest waiting; so many of a host, so many in all."""
    place = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("priority"), "seq"))
    return frontier.withColumn("place", place).filter(F.col("place") <= per_host).orderBy(F.desc("priority"), "seq").limit(budget)


def reached(seeds: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """(node, depth) of all nodes within so many links of the seeds (node): rounds of joins against what was seen."""
    seen = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for depth in range(1, most + 1):
        fresh = front.join(links, front["node"] == links["src"]).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        front = cut(fresh.withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def outcome(failed: Column, skipped: Column, fetch_error: Column, noindex: Column, near: Column, country: Column) -> Column:
    """What became of a page: the first of these that is so."""
    return F.when(failed, "failed").when(skipped, "skipped").when(fetch_error, "fetch_error").when(noindex, "noindex").when(near, "near_duplicate").when(country, "country_filtered").otherwise("written")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_replace(name, r"^\.+", ""), r"\.([^.]*)$", 1))


def file_findings(name: Column, size: Column) -> Column:
    """What is odd about a file, in a fixed order."""
    end = extension(name)
    checks = [
        F.when(end.isin(*SUSPICIOUS), "suspicious_extension").when(~end.isin(*EXPECTED), "unexpected_extension"),
        F.when(size == 0, "empty_file").when(size > MOST_BYTES, "file_too_large"),
        F.when(F.char_length(name) > LONGEST_NAME, "filename_too_long"),
        F.when(F.regexp_count(name, F.lit(r"\.")) > 1, "multiple_extensions"),
    ]
    return F.array_compact(F.array(*checks))


def first_verdict(findings: Column) -> Column:
    """What the metadata alone says: an ending that isn't known leaves a file unknown, any other finding makes it suspicious."""
    odd = F.filter(findings, lambda f: f != "unexpected_extension")
    return F.when(F.size(odd) > 0, "SUSPICIOUS").when(F.size(findings) > 0, "UNKNOWN").otherwise("SAFE")


def event_fault() -> Column:
    """Why a site event is refused; null if it isn't. Fields: type, version, run, host, bucket, key_prefix, documents_prefix."""
    c = F.col
    escapes = lambda x: F.coalesce(x, F.lit("")).startswith("/") | F.array_contains(F.split(F.coalesce(x, F.lit("")), "/"), "..")
    return (
        F.when(~c("type").eqNullSafe("site_crawled"), "type")
        .when(F.coalesce(c("version"), F.lit(1)) != 1, "version")
        .when(F.coalesce(c("host"), F.lit("")) == "", "missing")
        .when(F.coalesce(c("bucket"), F.lit("")) == "", "missing")
        .when(F.coalesce(c("documents_prefix"), F.lit("")) == "", "missing")
        .when(F.coalesce(c("run"), F.lit(0)) <= 0, "run")
        .when(~c("documents_prefix").endswith("/"), "prefix")
        .when(escapes(c("documents_prefix")) | escapes(c("key_prefix")), "escape")
        .when(c("host").contains("/") | (F.trim(c("host")) != c("host")) | c("host").isin(".", ".."), "host")
    )
