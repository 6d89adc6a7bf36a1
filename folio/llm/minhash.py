"""Near copies by the Jaccard likeness of their word shingles, found with MinHash bands.

SimHash fingerprints don't serve here: at a likeness of 0.8 they lie about ten
of 64 bits apart, beyond any ball that could be listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.llm.graph import components
from folio.llm.names import column, sliced
from folio.llm.simhash import BLOCK, keep_first
from folio.runtime import Scratch

#: Minima in a band, and bands: two texts of likeness 0.8 share a band with a chance of 1 - (1 - 0.8^5)^25 > 0.9999.
ROWS, BANDS = 5, 25
#: In one round a text is held against so many that follow it in a bucket; for that, buckets above CROWD members are dealt out.
REACH, CROWD = 16, 4096
#: In a bucket that then holds several groups it is held against so many, and a larger one is parted by WAYS times the minima of MORE further turns, in each of LEVELS rounds.
FULL, WAYS, MORE, LEVELS = 128, 2, 3, 12
#: Of 125 minima's low bytes two texts of likeness 0.8 have as many in common, give or take 5 standard deviations.
SURE = 5


def turns(n: int, seed: int) -> np.ndarray:
    """Hash functions: n pairs of an odd factor and a mask."""
    out = np.random.default_rng(seed).integers(1, 1 << 63, (n, 2), np.uint64)
    out[:, 0] |= np.uint64(1)
    return out


TURNS = turns(BANDS * ROWS, 42)


def shingles(text: bytes | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles. One that is shorter than
    the width is one shingle, one without words has none."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        words, width = [b" ".join(words)], 1
    runs = map(b" ".join, zip(*(words[i : len(words) - width + 1 + i] for i in range(width)), strict=True))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in runs), np.uint64, len(words) - width + 1))


def minima(of: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The least hash of a text's shingles by each of the functions."""
    low = np.full(len(by), ~np.uint64(0))
    for at in range(0, len(of), BLOCK):
        part = of[at : at + BLOCK]
        for i, (turn, flip) in enumerate(by):
            low[i] = min(low[i], ((part ^ flip) * turn).min())
    return low


def hashed(low: np.ndarray, rows: int) -> np.ndarray:
    """A hash of every so many minima."""
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), 42) for row in low.reshape(-1, rows)], np.uint64).view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, th: a hash of the text, key: a hash of its shingles, n of them, bands, sketch: the minima's low bytes) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 250):
            sets = [shingles(t, width) for t in b.column(2).to_pylist()]
            keys = np.array([xxhash.xxh64_intdigest(s.tobytes(), 7) for s in sets], np.uint64).view(np.int64)
            low = [minima(s, TURNS) for s in sets]
            found = np.concatenate([*(hashed(x, ROWS) for x in low), np.zeros(0, np.int64)])
            lists = pa.ListArray.from_arrays(np.arange(0, found.size + 1, BANDS, dtype=np.int32), pa.array(found))
            flat = np.concatenate([*low, np.zeros(0, np.uint64)]).astype(np.uint8).view(np.int8)
            sketch = pa.ListArray.from_arrays(np.arange(0, flat.size + 1, len(TURNS), dtype=np.int32), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys), pa.array([len(s) for s in sets], pa.int64()), lists, sketch], ["id", "th", "key", "n", "bands", "sketch"])

    rows = docs.select(column(id_col).alias("id"), F.xxhash64(column(text_col)).alias("th"), column(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, th long, key long, n long, bands array<long>, sketch array<tinyint>")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(key, text) to (key, shingles), a few texts' hashes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 250):
            sets = pa.array([shingles(t, width).view(np.int64) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), sets], ["key", "shingles"])

    return texts.mapInArrow(run, "key long, shingles array<long>")


def _ways(sets: DataFrame, level: int) -> DataFrame:
    """(key, shingles) to (key, ways): WAYS hashes of MORE minima each that no band or level before has."""
    by = turns(WAYS * MORE, 1000 + level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 250):
            found = [hashed(minima(np.array(s, np.int64).view(np.uint64), by), MORE) for s in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], ["key", "ways"])

    return sets.mapInArrow(run, "key long, ways array<long>")


def candidates(met: DataFrame, reach: int | None, likeness: float, salt: int) -> DataFrame:
    """(lo, hi) keys that share a band and could be alike by their counts n.

    met: band, value, key, n, root. Each key is held against the next ``reach`` of
    the same bucket that have another root, or all of them. Buckets above CROWD
    members are dealt at random to blocks of that size, in each band and round
    otherwise, but for the last round of all.
    """
    big = met.groupBy("band", "value").count().where(f"count > {CROWD}").select("band", "value", F.ceil(F.col("count") / CROWD).alias("blocks"))
    if reach is None or big.isEmpty():
        met = met.withColumn("block", F.lit(0))
    else:
        met = met.join(big, ["band", "value"], "left").withColumn("block", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("key", "band", F.lit(salt)), "blocks")).otherwise(0))
    after = W.partitionBy("band", "value", "block").orderBy("key").rowsBetween(1, W.unboundedFollowing if reach is None else reach)
    pairs = met.withColumn("next", F.collect_list(F.struct("key", "n", "root")).over(after)).where("size(next) > 0")
    pairs = pairs.select("key", "n", "root", F.explode("next").alias("x")).where(f"root <> x.root and least(n, x.n) >= {likeness} * greatest(n, x.n)")
    return pairs.select(F.least("key", "x.key").alias("lo"), F.greatest("key", "x.key").alias("hi")).distinct()


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, likeness: float = 0.8) -> DataFrame:
    """id, th and group of every row: the connected components of the pairs whose
    shingles have a Jaccard likeness of ``likeness`` or more.

    Each pair is verified on all shingles of both, after the low bytes of their
    minima have told those that are clearly apart. The first round holds each text
    against the next in every band, which joins most of a group; the second holds
    those that are still apart against REACH more, so in a bucket of up to
    REACH + 1 members no pair is passed over. Larger buckets whose members are not
    all joined by then are compared in full up to FULL + 1 members; those above are
    parted by further minima, in two ways at a time, so that a pair that shares
    several bands stays together in most of them, and this goes on until no such
    bucket is left. Whatever is left after LEVELS rounds is compared in full.
    Texts without words are alike.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    prints = scratch.save(signatures(docs, id_col, text_col, width), "prints")
    # max takes a row with an id where there is one
    one = prints.groupBy("key").agg(F.max(F.struct("id", "th")).alias("row"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    one = scratch.save(one, "classes")
    met = _shared(one.where("n > 0").select("key", "n", F.posexplode("bands").alias("band", "value")), scratch, "bands-0")
    # the shingles of all that may be a candidate in any round: texts are joined once
    wanted = scratch.save(met.select("key").distinct().join(one, "key").select("key", F.col("row.id").alias("_id"), F.col("row.th").alias("_th")), "wanted")
    texts = docs.select(column(id_col).alias("_i"), column(text_col).cast("binary").alias("_t"), F.xxhash64(column(text_col)).alias("_h"))
    texts = texts.join(wanted, texts["_i"].eqNullSafe(wanted["_id"]) & (texts["_h"] == wanted["_th"])).select("key", "_t")
    sets = scratch.save(_sets(texts, width).dropDuplicates(["key"]), "sets")
    sketches = one.select("key", "sketch")
    p, n = likeness + (1 - likeness) / 256, len(TURNS)
    least = n * p - SURE * (n * p * (1 - p)) ** 0.5
    edges = of = None

    def rooted() -> DataFrame:
        return met.withColumn("root", F.col("key")) if of is None else met.join(of, met["key"] == of["node"], "left").select(met["*"], F.coalesce("root", "key").alias("root"))

    def both(pairs: DataFrame, side: DataFrame, name: str) -> DataFrame:
        return pairs.join(side.select(F.col("key").alias("lo"), F.col(name).alias("a")), "lo").join(side.select(F.col("key").alias("hi"), F.col(name).alias("b")), "hi")

    def linked(reach: int | None, k: int) -> None:
        nonlocal edges, of
        pairs = scratch.save(candidates(rooted(), reach, likeness, k), f"pairs-{k}")
        equal = F.size(F.filter(F.zip_with("a", "b", lambda x, y: x == y), lambda x: x))
        near = scratch.save(both(pairs, sketches, "sketch").where(equal >= least).select("lo", "hi"), f"near-{k}")
        same = both(near, sets, "shingles").withColumn("same", F.size(F.array_intersect("a", "b")))
        alike = same.where(f"same >= {likeness} * (size(a) + size(b) - same)").select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        alike = scratch.save(alike, f"edges-{k}")
        scratch.drop(f"pairs-{k}", f"near-{k}")
        if of is not None and alike.isEmpty():
            return
        edges = alike if edges is None else edges.union(alike)
        of = scratch.save(components(edges, Scratch(docs.sparkSession, "jaccard")), f"roots-{k}")

    linked(1, 0)
    linked(REACH, 1)
    most = REACH + 1
    for level in range(1, LEVELS + 1):
        crowded = rooted().groupBy("band", "value").agg(F.count("*").alias("members"), F.min("root").alias("first"), F.max("root").alias("last"))
        crowded = scratch.save(crowded.where(f"members > {most} and first <> last").select("band", "value", "members"), f"crowded-{level}")
        if crowded.isEmpty():
            break
        before, met, most = f"bands-{level - 1}", scratch.save(met.join(crowded, ["band", "value"]), f"members-{level}"), FULL + 1
        scratch.drop(before)
        small, large = met.where(f"members <= {most}").select("key", "n", "band", "value"), met.where(f"members > {most}")
        if level < LEVELS and not large.isEmpty():
            ways = scratch.save(_ways(sets.join(large.select("key").distinct(), "key").select("key", "shingles"), level), f"ways-{level}")
            parted = large.join(ways, "key").select("key", "n", "band", "value", F.posexplode("ways").alias("way", "by"))
            small = small.unionByName(parted.select("key", "n", "band", F.xxhash64("band", "value", F.lit(level), "way", "by").alias("value")))
        elif level == LEVELS:
            small = met.select("key", "n", "band", "value")
        met = _shared(small, scratch, f"bands-{level}")
        linked(FULL if level < LEVELS else None, level + 1)
    scratch.drop("wanted", "sets")
    return prints.join(of, prints["key"] == of["node"], "left").select(F.col("id").alias(id_col), "th", F.coalesce("root", "key").alias("group"))


def _shared(met: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Members of the buckets that have several, written; the buckets are as well,
    so a bucket with very many members can be split where they meet."""
    met = scratch.save(met, f"all-{name}")
    crowd = scratch.save(met.groupBy("band", "value").count().where("count > 1").select("band", "value"), f"crowd-{name}")
    met = scratch.save(met.join(crowd, ["band", "value"]), name)
    scratch.drop(f"all-{name}", f"crowd-{name}")
    return met


def jaccard_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, likeness: float = 0.8) -> DataFrame:
    """docs with one row of each of jaccard_groups() kept, as near_dedup() does."""
    return keep_first(docs, jaccard_groups(docs, id_col, text_col, width, likeness), id_col, text_col)
