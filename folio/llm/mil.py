"""Quality scores by attention-based multiple-instance learning over passages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.names import column

PASSAGE, GRAM, HASHED = 512, 24, 256
FEATURES = 256 + HASHED + 3
#: Bounds of the training sample: labelled rows, and passages of all of them together.
SAMPLE, PASSAGES = 4000, 60_000
_SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
_MIX = np.random.default_rng(5).integers(1, 1 << 63, GRAM, dtype=np.uint64) | np.uint64(1)


def passages(text: bytes) -> np.ndarray:
    """Each passage of PASSAGE bytes as a vector: its bytes and hashed byte pairs
    by count, its words, and how many of its words begin a run of GRAM bytes that
    the text has more than once. An empty text has one empty passage."""
    b = np.frombuffer(text, np.uint8)
    n, m = len(b), max(1, -(-len(b) // PASSAGE))
    x = np.zeros((m, FEATURES), np.float32)
    if not n:
        return x
    at = np.arange(n) // PASSAGE
    x[:, :256] = np.bincount(at * 256 + b, minlength=m * 256).reshape(m, 256)
    pair = (b[:-1].astype(np.int64) * 167 + b[1:] * 59) % HASHED
    x[:, 256 : 256 + HASHED] = np.bincount(at[:-1] * HASHED + pair, minlength=m * HASHED).reshape(m, HASHED)
    gap = _SPACE[b]
    word = np.flatnonzero(np.append(True, gap[:-1]) & ~gap)
    words = np.bincount(at[word], minlength=m)
    long = word[word <= n - GRAM]
    if len(long) > 1:
        h = np.zeros(len(long), np.uint64)
        for j in range(GRAM):
            h += (b[long + j] + np.uint64(1)) * _MIX[j] * (b[long + j].astype(np.uint64) ^ np.uint64(0x5BD1E995))
        _, back, times = np.unique(h, return_inverse=True, return_counts=True)
        again = np.bincount(at[long], weights=times[back] > 1, minlength=m)
        x[:, -1] = 4 * again / np.maximum(words, 1)
    np.log1p(x[:, : 256 + HASHED], out=x[:, : 256 + HASHED])
    x[:, -3] = np.log1p(words)
    x[:, -2] = np.log1p(words.sum())
    return x


@dataclass
class Model:
    """h = tanh(x A + a); attention = softmax over a text's passages of
    (tanh(h V) * sigmoid(h U)) w; score = sigmoid(sum of attention * h times c + d)."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        p, size = self.p, np.diff(np.append(starts, len(x)))
        h = np.tanh(x @ p["A"] + p["a"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (v * u) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), size))
        att = e / np.repeat(np.add.reduceat(e, starts), size)
        z = np.add.reduceat(h * att[:, None], starts, axis=0)
        return {"h": h, "v": v, "u": u, "att": att, "z": z, "size": size, "s": 1 / (1 + np.exp(-(z @ p["c"] + p["d"])))}

    def gradient(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, starts)
        g = (f["s"] - y) / len(y)
        gz = np.repeat(g[:, None] * p["c"], f["size"], axis=0)
        along = (gz * f["h"]).sum(axis=1)
        ge = f["att"] * (along - np.repeat(np.add.reduceat(f["att"] * along, starts), f["size"]))
        gv, gu = ge[:, None] * p["w"] * f["u"] * (1 - f["v"] ** 2), ge[:, None] * p["w"] * f["v"] * f["u"] * (1 - f["u"])
        gh = (gz * f["att"][:, None] + gv @ p["V"].T + gu @ p["U"].T) * (1 - f["h"] ** 2)
        return {"A": x.T @ gh, "a": gh.sum(axis=0), "V": f["h"].T @ gv, "U": f["h"].T @ gu, "w": (f["v"] * f["u"]).T @ ge, "c": f["z"].T @ g, "d": g.sum()}

    def score(self, texts: list[bytes]) -> np.ndarray:
        """0 to 1 for each text. Texts are encoded a few hundred passages at a time."""
        out, held, n = [], [], 0
        for t in [*texts, None]:
            if held and (t is None or n > 400):
                x = (np.concatenate(held) - self.mean) / self.scale
                out.append(self.forward(x, np.cumsum([0, *(len(h) for h in held[:-1])]))["s"])
                held, n = [], 0
            if t is not None:
                held.append(passages(t))
                n += len(held[-1])
        return np.concatenate(out) if out else np.zeros(0)


def train(bags: list[np.ndarray], y: np.ndarray, hidden: int = 32, attention: int = 16, steps: int = 900, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4, seed: int = 3) -> Model:
    """Adam on the log loss of the texts' labels, with a fixed seed."""
    rng = np.random.default_rng(seed)
    rows = np.concatenate(bags) if bags else np.zeros((1, FEATURES), np.float32)
    near = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    share = float(np.clip((y.sum() + 1) / (len(y) + 2), 1e-3, 1 - 1e-3))
    p = {"A": near(FEATURES, hidden), "a": np.zeros(hidden, np.float32), "V": near(hidden, attention), "U": near(hidden, attention), "w": near(attention), "c": np.zeros(hidden, np.float32), "d": np.float32(np.log(share / (1 - share)))}
    model = Model(rows.mean(axis=0), rows.std(axis=0) + np.float32(0.05), p)
    if len(set(y.tolist())) < 2:
        return model  # every text gets the smoothed share of good labels
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    bags = [(b - model.mean) / model.scale for b in bags]
    while step < steps:
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            some = [bags[i] for i in pick]
            g, step = model.gradient(np.concatenate(some), np.cumsum([0, *(len(b) for b in some[:-1])]), y[pick]), step + 1
            lr = rate * max(0.05, 1 - step / steps)
            for k in p:
                grad = g[k] + decay * p[k]
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad**2
                p[k] = (p[k] - lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def held_out(id_col: str):
    """Rows that no label is learned from."""
    return F.coalesce(F.pmod(F.crc32(column(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, passages_in_all: int = PASSAGES) -> Model:
    """A model of labelled rows outside held_out(), with every passage of them.

    At most ``sample`` rows with at most ``passages_in_all`` passages together are
    taken, whole texts each: those whose ids hash lowest, passing over a row that
    would go beyond. An id with several labels counts as good if all are; null
    labels and ids don't count; rows that repeat an id and a text count once.
    """
    spark, known = docs.sparkSession, column(label_col).isNotNull() & ~held_out(id_col)
    marks = labels.where(known).groupBy(column(id_col).alias("id")).agg((F.min(column(label_col)) >= 1).cast("int").alias("y"))
    marks = marks.where("id is not null").orderBy(F.xxhash64("id"), "id").limit(sample)
    # at most ``sample`` rows are broadcast here and below
    rows = docs.select(column(id_col).alias("id"), F.coalesce(column(text_col).cast("binary"), F.lit(b"")).alias("text")).withColumn("th", F.xxhash64("text")).join(F.broadcast(marks), "id")
    sizes = rows.select("id", "th", F.greatest(F.lit(1), F.ceil(F.octet_length("text") / PASSAGE)).alias("n")).distinct()
    left, chosen = passages_in_all, []
    for r in sizes.orderBy(F.xxhash64("id"), "id", "th").limit(sample).collect():
        if r.n <= left:
            left, chosen = left - r.n, [*chosen, (r.id, r.th)]
    kind = rows.schema["id"].dataType.simpleString()
    wanted = spark.createDataFrame(chosen, f"id {kind}, th long")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = pa.array([passages(t).astype(np.float16).tobytes() for t in b.column(3).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], out], ["id", "th", "y", "x"])

    texts = rows.join(F.broadcast(wanted), ["id", "th"]).groupBy("id", "th").agg(F.min("y").alias("y"), F.min("text").alias("text"))
    found = sorted(texts.mapInArrow(encode, f"id {kind}, th long, y int, x binary").collect(), key=lambda r: (r.id, r.th))
    return train([np.frombuffer(r.x, np.float16).astype(np.float32).reshape(-1, FEATURES) for r in found], np.array([r.y for r in found], np.float32))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", cut: float = 0.7) -> DataFrame:
    """id, held_out, score and predicted (score >= cut) of each row.

    Null and empty texts get the score of one empty passage. Only the text makes
    a score, so rows that repeat it score alike. Without labels of both kinds each
    row gets the smoothed share of good ones. Empty tables give empty results.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col))  # of a fixed size
    names = [id_col, "held_out", "score", "predicted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                s = model.value.score(part.column(2).to_pylist()).astype(np.float64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s), pa.array((s >= cut).astype(np.int32))], names)

    rows = docs.select(column(id_col).alias("id"), held_out(id_col).alias("held"), F.coalesce(column(text_col).cast("binary"), F.lit(b"")).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
