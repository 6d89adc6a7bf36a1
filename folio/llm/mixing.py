"""Mixing sources to target weights by subset-sum budget fitting."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.llm.names import column, unused
from folio.runtime import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: The words that the knapsack may have to place once whole groups of equal length are settled.
WINDOW = 1 << 15
#: Rows of one source and length that one task ranks.
BUCKET = 20_000
#: Copies of one row that are made in one place.
DEAL = 1000


def fit(sizes: np.ndarray, counts: np.ndarray, budget: float) -> np.ndarray:
    """How many of the ``counts`` documents of each distinct size to take so that
    their sizes sum to the budget, or come near to it.

    Each length gives its share of the budget, rounded down; the longest fitting
    ones then fill up to WINDOW words short of it, and a bounded knapsack over all
    documents that are left places the rest exactly, if any subset of those does.
    The sum is never further from the budget than half the longest document, as
    filling up with what fits and one document more or less already comes so near.
    """
    order = np.argsort(-sizes, kind="stable")
    s, c, take = sizes[order].astype(np.int64), counts[order].astype(np.int64), np.zeros(len(sizes), np.int64)
    left, total = int(budget), int((s * c).sum())
    if total <= left:
        return counts.astype(np.int64)
    if left <= 0:
        return take
    take = np.floor(c * (left / total)).astype(np.int64)
    left -= int((take * s).sum())
    for i, size in enumerate(s):
        if left <= WINDOW:
            break
        more = min(int(c[i] - take[i]), (left - WINDOW + int(size) - 1) // int(size), left // int(size)) if size else 0
        take[i] += more
        left -= more * int(size)
    spare = c - take
    take += knapsack(s, spare, left)
    out = np.zeros_like(take)
    out[order] = take
    return out


def knapsack(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """The bounded subset sum nearest to the budget: counts to take of each size.
    Counts are split into powers of two; by[x] is the first such part that made the
    sum x, and earlier parts made the rest of it."""
    some = sizes[(counts > 0) & (sizes > 0)]
    most = budget + (int(some.min()) if len(some) else 0)
    reach, parts = np.zeros(most + 1, bool), []
    reach[0], by = True, np.full(most + 1, -1, np.int32)
    for i in range(len(sizes) - 1, -1, -1):
        size, n, k = int(sizes[i]), int(counts[i]), 1
        if not 0 < size <= most or reach[budget]:
            continue
        n = min(n, most // size)
        while n:
            k = min(k, n)
            if (w := k * size) > most:
                break
            fresh = reach[: most + 1 - w] & ~reach[w:]
            by[w:][fresh] = len(parts)
            reach[w:] |= fresh
            parts.append((i, k, w))
            n, k = n - k, 2 * k
    sums = np.flatnonzero(reach)
    out, x = np.zeros(len(sizes), np.int64), int(sums[np.argmin(np.abs(sums - budget))])
    while x:
        i, k, w = parts[by[x]]
        out[i] += k
        x -= w
    return out


def ranked(totals: DataFrame, scratch: Scratch) -> DataFrame:
    """totals with rank, the place of their source in the order of code points,
    null last: by ranges, as there may be many sources."""
    dealt = scratch.save(totals.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()), "ranges")
    # one row a range
    before = dealt.groupBy("range").count().withColumn("before", F.coalesce(F.sum("count").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(W.partitionBy("range").orderBy(F.col("source").asc_nulls_last()))
    return dealt.withColumn("own", own).join(before, "range").select("source", "source_size", (F.col("before") + F.col("own")).alias("rank"))


def targets(totals: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """totals (source, source_size, rank) with their target: all sizes' sum shared
    by weight, none above ``cap`` times its source, the excess reshared by weight.

    One row stands for each source; sums over them reach the driver in each turn.
    Weights go round by rank.
    """
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = totals.withColumn("w", w)
    whole = totals.agg(F.sum("source_size")).first()[0] or 0
    rate, full = 0.0, -1
    while True:
        above = F.lit(rate) * F.col("w") > cap * F.col("source_size") if full >= 0 else F.lit(False)
        r = rows.agg(F.count_if(above), F.sum(F.when(above, cap * F.col("source_size"))), F.sum(F.when(~above, F.col("w")))).first()
        if r[0] == full or not r[2]:
            break
        full, rate = r[0], (whole - (r[1] or 0)) / r[2]
    target = F.least(F.lit(rate) * F.col("w"), cap * F.col("source_size")).cast("double")
    return rows.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, seed: int = 11) -> DataFrame:
    """id, size, source_size, target and taken (words that the mix takes of the
    row, repeats counted) of each row.

    A source is taken as often in full as its target allows; a subset of its
    documents, fitted to the rest by length, is taken once more. Which of several
    with one length is decided by a seeded hash of id and text, so reruns agree.
    Null and empty texts have the size 0 and take 0. A null source is a source.
    Repeated rows count each. Empty tables give empty results.
    """
    draw = F.xxhash64(F.lit(seed), column(id_col), column(text_col))
    return _mix(docs, draw, id_col, text_col, source_col, weights, cap).select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def _mix(docs: DataFrame, draw: Column, id_col: str, text_col: str, source_col: str, weights: Sequence[float], cap: float) -> DataFrame:
    """id, size, source_size, target, taken and draw of each row; of rows with one
    source and length those with the least draws are taken once more."""
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = docs.select(column(id_col).alias("id"), column(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(column(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), draw.alias("draw"))
    rows = scratch.save(rows, "rows")
    lengths = scratch.save(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "lengths")
    totals = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    want = scratch.save(targets(scratch.save(ranked(totals, scratch), "ranked"), weights, cap), "targets")

    def plan(x: pd.DataFrame) -> pd.DataFrame:
        total, target = int(x.source_size.iloc[0]), float(x.target.iloc[0])
        times = int(target // total) if total else 0
        extra = fit(x["size"].to_numpy(), x.n.to_numpy(), round(target - times * total))
        return x[["source", "size", "n", "source_size", "target"]].assign(times=times, extra=extra)

    # one row for each length of a source, however many documents have it
    joined = lengths.join(want, lengths["source"].eqNullSafe(want["source"])).select(lengths["source"], "size", "n", "source_size", "target")
    plans = joined.groupBy("source").applyInPandas(plan, "source string, size long, n long, source_size long, target double, times long, extra long")
    # a length that very many documents share is dealt to buckets by draw, of which only one is ranked
    plans = scratch.save(plans.withColumn("buckets", F.ceil(F.col("n") / BUCKET)), "plans")
    spot = F.floor((F.shiftrightunsigned("draw", 1) / F.lit(2.0**63)) * F.col("buckets"))
    dealt = rows.join(plans.withColumnsRenamed({"source": "s", "size": "z"}), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).drop("s", "z").withColumn("bucket", F.least(spot, F.col("buckets") - 1))
    key = ["source", "size", "bucket"]
    filled = dealt.where("extra > 0 and extra < n and buckets > 1").groupBy(*key).agg(F.count("*").alias("m"))
    before = filled.withColumn("before", F.sum("m").over(W.partitionBy("source", "size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)))
    before = before.select(*(F.col(k).alias(f"b_{k}") for k in key), F.coalesce("before", F.lit(0)).alias("before"))
    split = dealt.where("extra > 0 and extra < n").join(before, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("size") == F.col("b_size")) & (F.col("bucket") == F.col("b_bucket")), "left")
    place = F.coalesce("before", F.lit(0)) + F.row_number().over(W.partitionBy(*key).orderBy("draw", "id"))
    some = split.withColumn("more", (place <= F.col("extra")).cast("long"))
    rest = dealt.where("extra <= 0 or extra >= n").withColumn("more", (F.col("extra") > 0).cast("long"))
    cols = ["id", "size", "source_size", "target", (F.col("size") * (F.col("times") + F.col("more"))).alias("taken"), "draw"]
    return some.select(*cols).unionByName(rest.select(*cols))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, seed: int = 11) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, all columns as
    they are, of any names. Rows without a word are never taken.

    Rows are told by a hash of all columns but maps. Equal rows share what is taken
    of them: each has the same part of it, and what is left over are copies of one.
    """
    plain = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]
    draw = F.xxhash64(F.lit(seed), *map(column, plain))
    key, mark, one, two, n, rows, spare = unused(docs.columns, "key", "mark", "one", "two", "n", "rows", "spare")
    found = _mix(docs, draw, id_col, text_col, source_col, weights, cap).where("taken > 0")
    takes = found.groupBy(F.col("id").alias(one), F.col("draw").alias(two)).agg(F.sum(F.expr("taken div size")).alias(n), F.count("*").alias(rows))
    told = docs.withColumns({key: column(id_col), mark: draw})
    told = told.join(takes, F.col(key).eqNullSafe(F.col(one)) & (F.col(mark) == F.col(two)))
    out = told.withColumn(spare, F.explode(F.expr(f"array_repeat(0, int({n} div {rows}))")))
    over = told.where(f"{n} % {rows} > 0").groupBy(key, mark, n, rows).agg(F.first(F.struct(*map(column, docs.columns))).alias(spare))
    # copies of one row are dealt out before they are made
    over = over.withColumn(two, F.explode(F.sequence(F.lit(0), F.expr(f"({n} % {rows} - 1) div {DEAL}")))).repartition(key, mark, two)
    over = over.withColumn(one, F.explode(F.expr(f"array_repeat(0, int(least({DEAL}, {n} % {rows} - {two} * {DEAL})))")))
    return out.select(*map(column, docs.columns)).unionByName(over.select(f"{spare}.*"))
