"""Streams with keyed state and timers: progress of running work, and loads of which only the latest count.

State lives in the store that transformWithState needs, RocksDB:
``spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)``.
With a checkpoint a query goes on where it stopped, and gives out nothing twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from folio.operators.ranks import at, free

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROGRESS = "doc_id {0}, generation long, page_no int, percent int, event string, text string"
SEGMENTS = "media_id {0}, seq long, start double, text string, done double"


def _kind(rows: DataFrame, name: str) -> str:
    return rows.schema[name].dataType.simpleString()


class _Pages(StatefulProcessor):
    """See page_progress()."""

    def __init__(self, idle_ms: int, out: list[str]):
        self.idle_ms, self.out = idle_ms, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", T.StructType([T.StructField("generation", T.LongType()), T.StructField("pages", T.IntegerType()), T.StructField("total", T.IntegerType()), T.StructField("timer", T.LongType())]))
        self.seen = handle.getMapState("seen", T.StructType([T.StructField("page_no", T.IntegerType())]), T.StructType([T.StructField("at", T.LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        generation, pages, total, timer = self.latest.get() if self.latest.exists() else (-1, 0, 0, 0)
        now, out = timerValues.getCurrentProcessingTimeInMs(), []
        for frame in rows:
            frame = frame.sort_values(["generation", "page_no"], kind="stable")
            for g, page, of, text in zip(frame.generation, frame.page_no, frame.total, frame.text, strict=True):
                g, page, of = int(g), int(page), int(of)
                if g < generation:
                    continue  # a load that has been superseded
                if g > generation:
                    generation, pages, total = g, 0, 0
                    self.seen.clear()
                if self.seen.containsKey((page,)):
                    continue
                self.seen.updateValue((page,), (now,))
                pages, total = pages + 1, max(total, of)
                event = "complete" if total and pages >= total else "page"
                out.append((key[0], g, page, int(pages / total * 100) if total > 0 else 0, event, text))
        if timer:
            self.handle.deleteTimer(timer)
        # a complete load's pages needn't be known any longer; its generation must
        if total and pages >= total:
            timer = 0
        else:
            timer = now + self.idle_ms
            self.handle.registerTimer(timer)
        self.latest.update((generation, pages, total, timer))
        yield pd.DataFrame(out, columns=self.out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        generation, pages, total, _ = self.latest.get()
        self.latest.update((generation, pages, total, 0))
        yield pd.DataFrame([(key[0], generation, None, int(pages / total * 100) if total > 0 else 0, "stalled", None)], columns=self.out)

    def close(self) -> None:
        pass


def page_progress(pages: DataFrame, idle_ms: int = 60_000) -> DataFrame:
    """What is new of documents that are being read: doc_id, generation, page_no,
    percent, event and text.

    pages: a stream of doc_id, generation (of the load), page_no, total, text.
    Each page is given out once, when it has come, with the share of pages that
    are there by then, instead of all pages so far each time; the last one is the
    event complete. Pages of a generation before the latest are refused however
    late they come, and a new generation begins anew. A load of which nothing has
    come for ``idle_ms`` gives out one row stalled, and goes on if more comes. Rows
    without a document, generation, page or total are left out. State is a number
    for each page of an open load and a row for each document.
    """
    x = pages.where("doc_id is not null and generation is not null and page_no is not null and total is not null").select("doc_id", F.col("generation").cast("long"), F.col("page_no").cast("int"), F.col("total").cast("int"), "text")
    kinds = PROGRESS.format(_kind(x, "doc_id"))
    step = _Pages(idle_ms, [c.split()[0] for c in kinds.split(", ")])
    return x.groupBy("doc_id").transformWithStateInPandas(step, kinds, "append", "processingTime")


class _Segments(StatefulProcessor):
    """See segment_progress()."""

    def __init__(self, out: list[str]):
        self.out = out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", T.StructType([T.StructField("seq", T.LongType()), T.StructField("text", T.StringType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        seq, last = self.last.get() if self.last.exists() else (-1, "")
        out = []
        every = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for n, start, end, duration, text in zip(every.seq, every.start, every.end, every.duration, every.text, strict=True):
            if n <= seq:
                continue
            seq, text = int(n), (text or "").strip()
            if text and text != last:
                last = text
                out.append((key[0], seq, start, text, min(end, duration) / duration if duration > 0 else None))
        self.last.update((seq, last))
        yield pd.DataFrame(out, columns=self.out)

    def close(self) -> None:
        pass


def segment_progress(segments: DataFrame) -> DataFrame:
    """What is new of media that are being transcribed: media_id, seq, start, text,
    and the share of the medium that is done.

    segments: a stream of media_id, seq, start, end, duration, text, each medium's
    in order of seq over the stream's batches. A segment that says what the one
    before said, or nothing, isn't given out; one whose seq has been is refused.
    State is a row for each medium.
    """
    kinds = SEGMENTS.format(_kind(segments, "media_id"))
    x = segments.where("media_id is not null and seq is not null").select("media_id", F.col("seq").cast("long"), F.col("start").cast("double"), F.col("end").cast("double"), F.col("duration").cast("double"), "text")
    return x.groupBy("media_id").transformWithStateInPandas(_Segments([c.split()[0] for c in kinds.split(", ")]), kinds, "append", "none")


class _Latest(StatefulProcessor):
    """See latest_loads()."""

    def __init__(self, out: list[str], digest: str):
        self.out, self.digest = out, digest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", T.StructType([T.StructField("generation", T.LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        before = self.latest.get()[0] if self.latest.exists() else None
        best = None
        for frame in rows:
            frame.columns = [*self.out, self.digest]  # Spark gives names that begin with an underscore anew
            top = frame.sort_values(["generation", self.digest], kind="stable").iloc[[-1]]
            if best is None or tuple(top[["generation", self.digest]].iloc[0]) >= tuple(best[["generation", self.digest]].iloc[0]):
                best = top
        if best is not None and (before is None or int(best.generation.iloc[0]) > before):
            self.latest.update((int(best.generation.iloc[0]),))
            yield best[self.out]

    def close(self) -> None:
        pass


def latest_loads(results: DataFrame) -> DataFrame:
    """Load results (doc_id, generation, more columns) whose generation is later
    than any before of their document, of a batch's rows the latest one only.

    Rows of a generation that has come, or of an earlier one, are refused however
    late they are: nothing is forgotten with time, as a document's state is one
    number. Of several rows of one generation in a batch that with the largest
    hash is taken, so reruns agree. Rows without a document or generation are left out.
    """
    x = results.where("doc_id is not null and generation is not null").withColumn("generation", F.col("generation").cast("long"))
    out = T.StructType(list(x.schema))
    (digest,) = free(x.columns, "digest")
    x = x.withColumn(digest, F.xxhash64(*map(at, x.columns)))
    return x.groupBy("doc_id").transformWithStateInPandas(_Latest(out.names, digest), out, "append", "none")
