"""Problem 9: a mixture in which each source has its target share of the total size in tokens.

Documents are counted by source and exact token length. A source's budget is its share of the total; whole rounds of all
its documents are taken while they fit, and the rest of the budget is filled by a bounded knapsack over the length
counts: lengths are first taken in proportion, and a dynamic programme over what is then left finds the largest sum that
fits. So many documents of each length are then picked in the order of a seeded hash.

Results: null texts are no part of the mixture; empty ones have no tokens and are used in whole rounds only. A source with
too little text is used `max_repeats` times and reported as short; a source without documents is short if it has a share.
Documents whose source is null or without target are left out. Ties between lengths go to the longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weir.llm.tokens import NAME, SPLIT, encoder
from weir.session import cut, spread

#: Tokens of a budget that are left to the dynamic programme; parts the documents of one length are ranked in.
EXACT, SALTS = 1 << 16, 64
SEED = 20


def length_batches(batches: Iterator[pa.RecordBatch], name: str, folder: str | None) -> Iterator[pa.RecordBatch]:
    encode, known = encoder(name, folder).encode_ordinary, {}
    for batch in batches:
        sizes = []
        for text in batch.column(2).to_pylist():
            size = 0
            for word in SPLIT.findall(text):
                n = known.get(word)
                if n is None:
                    if len(known) > 500_000:
                        known.clear()
                    n = known[word] = len(encode(word))
                size += n
            sizes.append(size)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["doc_id", "source", "tokens"])


def lengths(documents: DataFrame, targets: DataFrame, name: str = NAME, folder: str | None = None) -> DataFrame:
    """(doc_id, source, tokens, salt, position) of the documents of the targets' sources; the last two are seeded."""
    kept = spread(documents.filter("text IS NOT NULL").select("doc_id", "source", "text")).join(targets.select("source"), "source", "left_semi").select("doc_id", "source", "text")
    sized = kept.mapInArrow(lambda batches: length_batches(batches, name, folder), "doc_id long, source string, tokens long")
    position = F.xxhash64(F.lit(SEED), "doc_id")
    return sized.withColumn("position", position).withColumn("salt", F.pmod(position, F.lit(SALTS)).cast("int"))


def knapsack(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size to take so that their sum is as large as it can be without passing the budget."""
    taken = np.zeros(len(sizes), np.int64)
    left = int(budget)
    order = np.argsort(-sizes, kind="stable")
    weight = int((sizes * counts).sum())
    if left > EXACT and weight:
        part = min(1.0, (left - EXACT // 2) / weight)
        taken = np.floor(counts * part).astype(np.int64)
        left -= int((taken * sizes).sum())
    for k in order:  # what proportion leaves over, the long ones first
        if left <= EXACT:
            break
        if sizes[k]:
            more = min(int(counts[k] - taken[k]), (left - EXACT // 2) // int(sizes[k]))
            if more > 0:
                taken[k] += more
                left -= more * int(sizes[k])
    return taken + exact(sizes, counts - taken, left)


def exact(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """The dynamic programme: sets of reachable sums as bits, a size taken 1, 2, 4 ... times at once."""
    taken = np.zeros(len(sizes), np.int64)
    full = (1 << (budget + 1)) - 1
    reach, steps = 1, []
    for k in np.argsort(-sizes, kind="stable"):
        size = int(sizes[k])
        if not 0 < size <= budget or not counts[k]:
            continue
        left, once = min(int(counts[k]), budget // size), 1
        while left > 0:
            once = min(once, left)
            new = (reach | reach << (size * once)) & full
            if new != reach:
                steps.append((k, once, reach))
                reach = new
            left -= once
            once *= 2
        if reach >> budget & 1:
            break
    rest = reach.bit_length() - 1
    for k, once, before in reversed(steps):
        if not before >> rest & 1:
            taken[k] += once
            rest -= once * int(sizes[k])
    return taken


def plan_source(histogram: pd.DataFrame) -> pd.DataFrame:
    """Of one source's counts by length and salt: whole rounds for all, and how many of each get one use more."""
    first = histogram.iloc[0]
    total, budget, most = int((histogram.tokens * histogram.n).sum()), float(first.budget), int(first.max_repeats)
    rounds = most if total * most <= budget or not total else int(budget // total)
    extra = np.zeros(len(histogram), np.int64)
    if rounds < most:
        by_size = histogram.groupby("tokens").n.sum()
        sizes, counts = by_size.index.to_numpy(np.int64), by_size.to_numpy(np.int64)
        chosen = dict(zip(sizes, knapsack(sizes, counts, int(budget - rounds * total)), strict=True))
        for k, (size, n) in enumerate(zip(histogram.tokens, histogram.n, strict=True)):
            extra[k] = min(n, chosen[size])
            chosen[size] -= extra[k]
    return pd.DataFrame({"source": histogram.source, "tokens": histogram.tokens, "salt": histogram.salt, "n": histogram.n, "rounds": rounds, "extra": extra})


def targets_with_budgets(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """The targets with what their sources have and what they should give: a row for each target."""
    has = sized.groupBy("source").agg(F.sum("tokens").alias("available"), F.count("*").alias("documents"))
    total = has.agg(F.coalesce(F.sum("available"), F.lit(0)).alias("total")).scalar()
    joined = targets.join(has, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    return joined.withColumn("budget", F.col("target_share") * total)


def mixture(documents: DataFrame, targets: DataFrame, name: str = NAME, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, tokens, uses) of the documents used, and the report: a row for each target."""
    sized = cut(lengths(documents, targets, name, folder))
    budgets = targets_with_budgets(sized, targets)
    counts = sized.groupBy("source", "tokens", "salt").agg(F.count("*").alias("n"))
    histogram = counts.join(budgets.select("source", "budget", "max_repeats"), "source")
    plan = cut(histogram.groupBy("source").applyInPandas(lambda rows: plan_source(rows.sort_values(["tokens", "salt"])), "source string, tokens long, salt int, n long, rounds int, extra long"))
    ranked = sized.join(plan, ["source", "tokens", "salt"]).withColumn("place", F.row_number().over(Window.partitionBy("source", "tokens", "salt").orderBy("position", "doc_id")))
    used = ranked.withColumn("uses", F.col("rounds") + (F.col("place") <= F.col("extra")).cast("int")).filter("uses > 0")
    reached = plan.groupBy("source").agg(F.sum(F.expr("tokens * (n * rounds + extra)")).alias("reached"), F.max("rounds").alias("rounds"))
    # what the plan couldn't fill although every document is used as often as it may be
    short = (F.coalesce("rounds", "max_repeats") >= F.col("max_repeats")) & (F.coalesce("reached", F.lit(0)) < F.col("budget"))
    whole = reached.agg(F.sum("reached").alias("whole")).scalar()
    report = budgets.join(reached, "source", "left").select("source", "target_share", "max_repeats", "available", "budget", F.coalesce("reached", F.lit(0)).alias("reached"), F.coalesce(F.col("reached") / whole, F.lit(0.0)).alias("reached_share"), short.alias("short"))
    return used.select("doc_id", "source", "tokens", "uses"), report
