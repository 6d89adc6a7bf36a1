"""Document fingerprints: quartile bucket digests of hashed byte triplets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.runtime import Scratch

BUCKETS, SLICE = 256, 1 << 20
#: Points for codes 0, 1, 2 or 3 quartiles apart, and the mean of unrelated digests in a bucket.
POINTS = np.array([0, 1, 2, 4])
UNRELATED = 1.375
RESULT = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def bucket_counts(b: bytes) -> np.ndarray:
    """How many of the byte triplets fall into each bucket by their hash."""
    x, out = np.frombuffer(b, np.uint8), np.zeros(BUCKETS, np.int64)
    for at in range(0, len(x) - 2, SLICE):
        y = x[at : at + SLICE + 2].astype(np.uint32)
        h = (y[:-2] << np.uint32(16) | y[1:-1] << np.uint32(8) | y[2:]) * np.uint32(0x9E3779B1)
        out += np.bincount((h ^ h >> np.uint32(15)) * np.uint32(0x85EBCA77) >> np.uint32(24), minlength=BUCKETS)
    return out


def codes(b: bytes) -> tuple[np.ndarray, int]:
    """The quartile, 0 to 3, of each bucket's count, and the length on a log scale."""
    c = bucket_counts(b)
    q = np.sort(c)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    return (c[:, None] > q).sum(axis=1).astype(np.uint8), min(255, round(8 * math.log2(1 + len(b))))


def digest(code: tuple[np.ndarray, int]) -> str:
    """Hex of the length byte and four quartile codes to a byte."""
    four = code[0].reshape(-1, 4)
    return f"{code[1]:02x}" + bytes(four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]).hex()


def undigest(s: str) -> tuple[np.ndarray, int]:
    b = np.frombuffer(bytes.fromhex(s), np.uint8)
    return np.stack([b[1:] >> 6, b[1:] >> 4 & 3, b[1:] >> 2 & 3, b[1:] & 3], axis=1).ravel(), int(b[0])


def likeness(x: tuple[np.ndarray, int], y: tuple[np.ndarray, int]) -> float:
    """1 for equal digests, 0 for a difference as of unrelated ones or more.
    Lengths count from a factor of about two on."""
    apart = np.abs(x[0].astype(np.int8) - y[0].astype(np.int8))
    score = int(POINTS[apart].sum()) + 4 * max(0, abs(x[1] - y[1]) - 8)
    bound = BUCKETS * UNRELATED
    return 1 - min(score, bound) / bound


def _compare(rows: Iterator[tuple], part: int) -> Iterator[tuple]:
    """Rows (id, text) in order to results of each but the last, and the texts of
    the first and the last, which neighbouring partitions need."""
    before = None
    for at, text in rows:
        now = (at, text or "", codes((text or "").encode()))
        if before is None:
            yield ("head", part, at, text, *[None] * 6)
        else:
            yield ("full", part, before[0], None, *_result(before, now))
        before = now
    if before is not None:
        yield ("tail", part, before[0], before[1], *[None] * 6)


def _result(one: tuple, after: tuple) -> tuple:
    n = len(one[1])
    edited = (one[1][: n - n // 3] + after[1][: n // 3]).encode()
    own, new = one[2], codes(edited)
    return n, hashlib.sha256(edited).hexdigest(), digest(own), digest(new), likeness(own, new), likeness(own, after[2])


def _batches(found: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in found:
        held.append(r)
        if len(held) == 2000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _schema(kinds: str) -> pa.Schema:
    of = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32()}
    return pa.schema([(n, of[k]) for n, k in (x.split() for x in kinds.split(", "))])


def neighbour_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each row: the digest of its text, of its edited text (the last third
    replaced by the beginning of the next document), and how alike the text is to
    that and to the next one. The next document has the next lower id, the last
    one's is the first.

    Null and empty texts have the digest of an empty text, and any two equal texts
    have equal digests. Ids are integers; a null id comes last, and of rows with
    one id that with the smaller hash of its text first. Other columns aren't
    read. An empty table gives an empty result.

    Texts go through one range exchange, so that neighbours share a task. Each
    task leaves its first and last text for its neighbours: two texts a
    partition, joined by partition number.
    """
    scratch = Scratch(docs.sparkSession, "digest")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))
    order = [F.col("id").desc_nulls_last(), F.col("th")]
    kinds = "kind string, part int, id long, text string, " + RESULT.removeprefix("id long, ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        yield from _batches(_compare(each, TaskContext.get().partitionId()), _schema(kinds))

    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    found = scratch.save(dealt.mapInArrow(run, kinds), "found")
    heads = found.where("kind = 'head'").select(F.col("part").alias("next"), F.col("text").alias("next_text"))
    parts = found.where("kind = 'head'").select("part")
    # one row for each partition with rows
    first = parts.agg(F.min("part")).first()[0]
    after = parts.select("part", F.coalesce(F.lead("part").over(W.orderBy("part")), F.lit(first)).alias("next"))
    tails = found.where("kind = 'tail'").select("part", "id", "text").join(after, "part").join(heads, "next").select("id", "text", "next_text")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = zip(*(c.to_pylist() for c in b.columns), strict=True)
            yield from _batches(((i, *_result((i, t or "", codes((t or "").encode())), (None, u or "", codes((u or "").encode())))) for i, t, u in each), _schema(RESULT))

    names = [x.split()[0] for x in RESULT.split(", ")]
    out = found.where("kind = 'full'").select(*names).unionByName(tails.mapInArrow(join, RESULT))
    return out.withColumnRenamed("id", id_col)
