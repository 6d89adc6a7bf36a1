"""Near duplicates by SimHash fingerprints and meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.llm.graph import components
from folio.llm.names import column, sliced, unused
from folio.runtime import Scratch

BLOCK = 1 << 15


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """The signed 64-bit SimHash of a text's word shingles; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < width:
        words, width = [b" ".join(words)], 1
    ones, n = np.zeros(64, np.int64), len(words) - width + 1
    for at in range(0, n, BLOCK):
        part = words[at : min(at + BLOCK, n) + width - 1]
        shingles = map(b" ".join, zip(*(part[i : len(part) - width + 1 + i] for i in range(width)), strict=True))
        h = np.array([xxhash.xxh64_intdigest(s, seed) for s in shingles], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, th: a hash of the text, fp long) of every row of docs. bytes.split() cuts at the six ASCII
    white-space characters and bytes.lower() touches A-Z only, as the definition
    of a word asks. A null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1000):
            fp = pa.array([fingerprint(t, width) for t in b.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fp], ["id", "th", "fp"])

    rows = docs.select(column(id_col).alias("id"), F.xxhash64(column(text_col)).alias("th"), column(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, th long, fp long")


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """(lo, hi) pairs of distinct fingerprints (column fp) within ``radius`` bits.

    Each fingerprint emits all values within half the radius, so two of them at
    the radius or nearer meet at one value at least. All that meet at a value are
    within the radius of each other, so a chain through them keeps every
    connection with one row less than there are members; a value is met by 65
    fingerprints at most for the radius 2. Pairs are verified and given once.
    """
    if radius not in (0, 2):
        raise ValueError("the radius is 0 or 2")
    if not radius:
        return prints.select(F.col("fp").alias("lo"), F.col("fp").alias("hi")).where("false")
    met = prints.select("fp", F.explode(F.expr("array_append(transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)), fp)")).alias("variant"))
    chain = met.withColumn("lo", F.lag("fp").over(W.partitionBy("variant").orderBy("fp"))).where("lo is not null")
    return chain.select("lo", F.col("fp").alias("hi")).where(f"bit_count(lo ^ hi) <= {radius}").distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """id, th, fp, group, component_id (smallest id reachable over links) for each
    row; th is a hash of the text, group a fingerprint that names the component.

    Rows with a null text or without words have the fingerprint 0 and are linked
    like any others. Repeated rows come back repeated. Ids are integers; a null id
    takes no part in the choice of the smallest. Other columns of docs are not
    read. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.save(fingerprints(docs, id_col, text_col, width), "prints")
    one = scratch.save(prints.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    pairs = links(one.select("fp"), radius)
    # fingerprints are the nodes; a component's name is the least id among its classes
    of = components(pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")), scratch)
    named = one.join(of.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = scratch.save(named.join(least, "root").select("fp", F.col("root").alias("group"), "component_id"), "components")
    return prints.join(of, "fp").select(F.col("id").alias(id_col), "th", "fp", "group", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """docs with one row of each group kept: the one with the smallest id.

    All columns stay as they are. Of rows that share that id in their group, that
    with the least hash of its text stays, once. Rows with a null id can't be told
    from each other and stay.
    """
    return keep_first(docs, simhash_groups(docs, id_col, text_col, radius=radius), id_col, text_col)


def keep_first(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """near_dedup() for the id, th and group of each row of docs."""
    spark, key, mark = docs.sparkSession, *unused(docs.columns, "key", "mark")
    groups = Scratch(spark, "near").save(groups.where(column(id_col).isNotNull()).select(column(id_col).alias(key), F.col("th").alias(mark), "group"), "groups")
    first = groups.groupBy("group").agg(F.min(F.struct(key, mark)).alias("x")).select("x.*")
    gone = groups.select(key, mark).distinct().join(first, [key, mark], "left_anti")
    told = docs.withColumns({key: column(id_col), mark: F.xxhash64(column(text_col))})
    left = told.join(gone, [key, mark], "left_anti")
    if not groups.groupBy(key, mark).count().where("count > 1").isEmpty():
        left = left.where(F.col(key).isNotNull()).dropDuplicates([key, mark]).unionByName(left.where(F.col(key).isNull()))
    return left.select(*map(column, docs.columns))
