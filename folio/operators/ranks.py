"""Places, running sums, islands and folds of groups of any size, without a task for each group."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from folio.runtime import Scratch

#: Rows of a group that one task may go through; larger groups are dealt out by ranges.
LARGE = 50_000


def free(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, with underscores before those that a column has already."""
    seen, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in seen:
            name = f"_{name}"
        seen.add(name.lower())
        out.append(name)
    return out


def at(name: str) -> Column:
    """The column of exactly this name."""
    return F.col("`" + name.replace("`", "``") + "`")


def dealt(rows: DataFrame, by: list[str], order: list[str | Column], part: str, pos: str, scratch: Scratch) -> DataFrame:
    """rows written in ranges of group and order, with the range and a number that
    rises with group and order. Equal rows are told apart, so they needn't share a range."""
    (tie,) = free(rows.columns, "tie")
    keys = [*(at(c).asc_nulls_first() for c in by), *order, tie]
    x = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(tie)
    return scratch.save(x.withColumns({part: F.spark_partition_id(), pos: F.monotonically_increasing_id()}), "dealt")


def _with(rows: DataFrame, by: list[str], part: str, parts: DataFrame) -> DataFrame:
    """rows with what each group's range carries: parts has by and part, then named columns."""
    names = free([*rows.columns, *parts.columns], *(f"k{i}" for i in range(len(by) + 1)))
    renamed = parts.select(*(at(c).alias(n) for c, n in zip([*by, part], names, strict=True)), *(at(c) for c in parts.columns if c not in (*by, part)))
    met = at(part) == at(names[-1])
    for c, n in zip(by, names[:-1], strict=True):
        met &= at(c).eqNullSafe(at(n))
    return rows.join(renamed, met).drop(*names)


def parted(rows: DataFrame, by: list[str], scratch: Scratch, sizes: DataFrame | None = None) -> list[tuple[DataFrame, bool]]:
    """rows in up to two parts: those of groups of at most LARGE rows, and those of
    larger ones (True). sizes: by and n, added up, where that is less to read than
    the rows. No part is left out; a part without groups isn't there."""
    n = (rows.select(*map(at, by), F.lit(1).alias("n_of")) if sizes is None else sizes.select(*map(at, by), F.col("n").alias("n_of"))).groupBy(*map(at, by)).agg(F.sum("n_of").alias("n_of"))
    if not by:
        # all rows are one group, which has no key that could be written
        return [(rows, not n.where(F.col("n_of") > LARGE).isEmpty())]
    names = free(rows.columns, *(f"g{i}" for i in range(len(by))))
    # one row for each LARGE rows at most
    large = scratch.save(n.where(F.col("n_of") > LARGE).select(*(at(c).alias(g) for c, g in zip(by, names, strict=True))), "large")
    if large.isEmpty():
        return [(rows, False)]
    met = F.lit(True)
    for c, g in zip(by, names, strict=True):
        met &= at(c).eqNullSafe(at(g))
    return [(rows.join(large, met, "left_anti"), False), (rows.join(large, met, "left_semi"), True)]


def either(parts: list[tuple[DataFrame, bool]], small: Callable[[DataFrame], DataFrame], large: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The parts of parted(), each worked out in its way, together."""
    first, *rest = [large(x) if is_large else small(x) for x, is_large in parts]
    return first.union(rest[0]) if rest else first


def running(rows: DataFrame, by: list[str], order: list[str | Column], value: Column | None = None) -> DataFrame:
    """rows with place, from 1 within each group in the order, and ahead, the sum of
    value over the rows before it.

    Rows are dealt out by ranges of group and order and written. Within a range
    windows see one part of a group each; sums over the parts, one row a group and
    range, are added to them. A group that holds most of the rows is spread over
    many ranges. Groups of up to LARGE rows are windows of their own. Columns of any
    other name come back as they are.
    """

    def small(x: DataFrame) -> DataFrame:
        val, tie = free(x.columns, "value", "tie")
        own = W.partitionBy(*map(at, by)).orderBy(*order, tie)
        x = x.withColumns({val: F.lit(0) if value is None else value, tie: F.monotonically_increasing_id()})
        return x.select(*map(at, rows.columns), F.row_number().over(own).cast("long").alias("place"), F.coalesce(F.sum(val).over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))

    return either(parted(rows, by, Scratch(rows.sparkSession, "ranks")), small, lambda x: _running(x, by, order, value))


def _running(rows: DataFrame, by: list[str], order: list[str | Column], value: Column | None) -> DataFrame:
    part, pos, val, n, total, local, sums = free(rows.columns, "part", "pos", "value", "n_before", "sum_before", "local", "sums")
    x = dealt(rows.withColumn(val, F.lit(0) if value is None else value), by, order, part, pos, Scratch(rows.sparkSession, "ranks"))
    parts = x.groupBy(*map(at, by), part).agg(F.count("*").alias(n), F.sum(val).alias(total))
    before = W.partitionBy(*map(at, by)).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(*map(at, by), part, *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in (n, total)))
    own = W.partitionBy(*map(at, by), part).orderBy(pos)
    x = x.withColumns({local: F.row_number().over(own), sums: F.coalesce(F.sum(val).over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))})
    return _with(x, by, part, parts).select(*map(at, rows.columns), (F.col(local) + F.col(n)).alias("place"), (F.col(sums) + F.col(total)).alias("ahead"))


def islands(rows: DataFrame, by: list[str], start: str, end: str, gap: float = 0.0, name: str = "island") -> DataFrame:
    """rows with the number, from 1 in each group, of the island they are in: one
    begins where a start is more than ``gap`` beyond every end before it.

    A running maximum over ranges of the starts, as in running(); a group may have
    any share of the rows, and one of up to LARGE is a window. Starts and ends
    mustn't be null.
    """

    def small(x: DataFrame) -> DataFrame:
        (new,) = free([*x.columns, name], "new")
        own = W.partitionBy(*map(at, by)).orderBy(at(start), at(end))
        before = F.max(at(end)).over(own.rowsBetween(W.unboundedPreceding, -1))
        x = x.withColumn(new, F.coalesce(at(start) > before + gap, F.lit(True)).cast("long"))
        return x.select(*map(at, rows.columns), F.sum(new).over(own.rowsBetween(W.unboundedPreceding, 0)).alias(name))

    return either(parted(rows, by, Scratch(rows.sparkSession, "islands")), small, lambda x: _islands(x, by, start, end, gap, name))


def _islands(rows: DataFrame, by: list[str], start: str, end: str, gap: float, name: str) -> DataFrame:
    scratch = Scratch(rows.sparkSession, "islands")
    part, pos, far, new, ahead = free(rows.columns, "part", "pos", "far", "new", "ahead")
    x = dealt(rows, by, [at(start), at(end)], part, pos, scratch)
    over = W.partitionBy(*map(at, by)).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    parts = x.groupBy(*map(at, by), part).agg(F.max(at(end)).alias(far)).select(*map(at, by), part, F.max(far).over(over).alias(far))
    own = W.partitionBy(*map(at, by), part).orderBy(pos)
    before = F.greatest(F.max(at(end)).over(own.rowsBetween(W.unboundedPreceding, -1)), F.col(far))
    x = scratch.save(_with(x, by, part, parts).withColumn(new, F.coalesce(at(start) > before + gap, F.lit(True)).cast("long")).drop(far), "new")
    scratch.drop("dealt")
    parts = x.groupBy(*map(at, by), part).agg(F.sum(new).alias(ahead)).select(*map(at, by), part, F.coalesce(F.sum(ahead).over(over), F.lit(0)).alias(ahead))
    x = x.withColumn(new, F.sum(new).over(own.rowsBetween(W.unboundedPreceding, 0)))
    return _with(x, by, part, parts).select(*map(at, rows.columns), (F.col(new) + F.col(ahead)).alias(name))


class Fold(Protocol):
    """A fold that can be cut anywhere: what a stretch of rows makes of any state is
    summed up in something small, so stretches are worked out side by side."""

    begin: Any

    def summary(self, rows: Iterator[tuple]) -> Any: ...

    def after(self, state: Any, summary: Any) -> Any: ...

    def outputs(self, state: Any, rows: Iterator[tuple]) -> Iterator[tuple]: ...


def values(c: pa.Array) -> list:
    """to_pylist(), by whole columns where that is quicker."""
    kind = c.type
    if pa.types.is_string(kind) or not c.null_count and (pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_boolean(kind)):
        return c.to_numpy(zero_copy_only=False).tolist()
    if pa.types.is_list(kind) and not c.null_count:
        flat, ends = values(c.flatten()), (c.offsets.to_numpy() - c.offsets[0].as_py()).tolist()
        return [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    return c.to_pylist()


def _rows(batches: Iterator[pa.RecordBatch], most: int = 2000) -> Iterator[tuple]:
    for b in batches:
        for k in range(0, b.num_rows, most):
            yield from zip(*map(values, b.slice(k, most).columns), strict=True)


def _batches(rows: Iterator[tuple], kinds: T.StructType, most: int = 2000) -> Iterator[pa.RecordBatch]:
    schema, held = to_arrow_schema(kinds), []
    for r in rows:
        held.append(r)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def mapped(rows: DataFrame, step: Callable[[Iterator[tuple]], Iterator[tuple]], kinds: T.StructType) -> DataFrame:
    """Rows through a generator, a few at a time."""
    return rows.mapInArrow(lambda batches: _batches(step(_rows(batches)), kinds), kinds)


def _whole(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    """Batches of sorted rows cut so that no group (of the first n columns) is in two
    of them, each with its rows' keys."""
    held: list[pa.RecordBatch] = []
    for b in chain(batches, [None]):
        held += [b] if b is not None and b.num_rows else []
        if not held or b is not None and not b.num_rows:
            continue
        x = pa.concat_batches(held)
        keys = list(zip(*map(values, x.columns[:n]), strict=True)) if n else [()] * x.num_rows
        k = len(keys)
        if b is not None:
            while k and keys[k - 1] == keys[-1]:
                k -= 1
        held = [x.slice(k)] if k < len(keys) else []
        if k:
            yield x.slice(0, k), keys[:k]


def grouped(rows: DataFrame, by: list[str], order: list[str | Column], columns: list[str], step: Callable[[list[tuple]], Iterable[tuple]], outputs: str) -> DataFrame:
    """rows with the outputs ("name type, ...") that step makes of each group's rows
    in their order, given the columns, one a row. A group is gone through by one
    task; only keys and columns become Python values."""
    made = rows.sparkSession.createDataFrame([], outputs).schema
    x = rows.select(*map(at, by), *(at(c) for c in rows.columns if c not in by))
    places = [x.columns.index(c) for c in columns]
    kinds, schema, n = T.StructType([*x.schema, *made]), to_arrow_schema(made), len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, keys in _whole(batches, n):
            given, out, i = list(zip(*(values(b.column(k)) for k in places), strict=True)), [], 0
            for _, of in groupby(keys):
                k = i + sum(1 for _ in of)
                out.extend(step(given[i:k]))
                i = k
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True))], names=kinds.names)

    # numbers of partitions that adaptive execution may put together
    x = (x.repartition(*map(at, by)) if by else x.repartition(1)).sortWithinPartitions(*(at(c).asc_nulls_first() for c in by), *order)
    return x.mapInArrow(run, kinds).select(*map(at, rows.columns), *map(at, made.names))


def folded(rows: DataFrame, by: list[str], order: list[str | Column], columns: list[str], fold: Fold, outputs: str, sizes: DataFrame | None = None) -> DataFrame:
    """rows with the outputs ("name type, ...") of a fold over each group's rows in
    their order, given the columns. Groups of up to LARGE rows are folded whole, by
    one task each (grouped()), larger ones over ranges. sizes: as for parted()."""
    parts = parted(rows, by, Scratch(rows.sparkSession, "fold"), sizes)
    return either(parts, lambda x: grouped(x, by, order, columns, lambda of: fold.outputs(fold.begin, iter(of)), outputs), lambda x: _folded(x, by, order, columns, fold, outputs))


def _folded(rows: DataFrame, by: list[str], order: list[str | Column], columns: list[str], fold: Fold, outputs: str) -> DataFrame:
    """Rows are dealt out by ranges and written. Each range of a group is summed up
    by itself; a group's summaries, one a range, are put together in order, which
    gives the state each range begins with; then each range is folded by itself.
    So a group may have any share of the rows, and no task sees more of it than
    a range.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "fold")
    part, pos, back, has = free([*rows.columns, *(x.split()[0] for x in outputs.split(", "))], "part", "pos", "back", "has")
    x = dealt(rows, by, order, part, pos, scratch)
    n = len(by) + 1
    narrow = x.select(*map(at, by), part, pos, *map(at, columns))
    keys = T.StructType(narrow.schema[:n])
    in_order = lambda df: df.repartition(*map(at, by), part).sortWithinPartitions(*map(at, by), part, pos)

    def summed(given: Iterator[tuple]) -> Iterator[tuple]:
        for key, of in groupby(given, lambda r: r[:n]):
            yield *key, pickle.dumps(fold.summary(r[n + 1 :] for r in of))

    def entered(given: Iterator[tuple]) -> Iterator[tuple]:
        for _, of in groupby(given, lambda r: r[: n - 1]):
            state = fold.begin
            for r in of:
                yield *r[:n], pickle.dumps(state)
                state = fold.after(state, pickle.loads(r[n]))

    def carried(given: Iterator[tuple]) -> Iterator[tuple]:
        for _, of in groupby(given, lambda r: r[:n]):
            first = next(of)
            places = [first[n]]

            def row(of: Iterator[tuple] = of, first: tuple = first, places: list[int] = places) -> Iterator[tuple]:
                yield first[n + 1 : -1]
                for r in of:
                    places[0] = r[n]
                    yield r[n + 1 : -1]

            # an output comes with its row, before the next one is asked for
            for out in fold.outputs(pickle.loads(first[-1]), row()):
                yield places[0], *out

    sums = mapped(in_order(narrow), summed, T.StructType([*keys, T.StructField(has, T.BinaryType())]))
    states = mapped((sums.repartition(*map(at, by)) if by else sums.repartition(1)).sortWithinPartitions(*map(at, by), part), entered, T.StructType([*keys, T.StructField(has, T.BinaryType())]))
    states = scratch.save(states, "states")
    given = _with(narrow, by, part, states)
    made = spark.createDataFrame([], outputs).schema
    done = mapped(in_order(given), carried, T.StructType([T.StructField(back, T.LongType()), *made]))
    return x.join(done, F.col(pos) == F.col(back)).select(*map(at, rows.columns), *map(at, made.names))
