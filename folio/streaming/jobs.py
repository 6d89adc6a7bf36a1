"""Streams: files as they arrive, and transcripts that grow."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folio.operators.transcript import Grouping
from folio.sources.files import imported


def arriving(spark: SparkSession, folder: str, per_batch: int = 100) -> DataFrame:
    """Documents (path, text, error) of files as they come into a folder, each once."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", "true").load(folder)
    return imported(found)


def growing_groups(snippets: DataFrame, length: float = 15.0, most: float = 30.0, pause: float | None = None) -> DataFrame:
    """Sentence groups (media_id, start, text) of snippet streams, given out as
    they end. The open group of a medium is its state; a medium whose snippets
    don't come for ten minutes gives out what is open."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = tuple(state.get) if state.exists else None
        groups = Grouping(length, most, pause, (held[0], held[1], list(held[2])) if held else None)
        out: list[tuple[float, str]] = []
        if state.hasTimedOut:
            out += [groups.flush()] if groups.texts else []
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values(["start", "seq"])
            for start, text in zip(rows.start, rows.text, strict=True):
                out += groups.add(start, text)
            state.update((groups.start, groups.last, groups.texts))
            state.setTimeoutDuration(600_000)
        yield pd.DataFrame([(key[0], *g) for g in out], columns=["media_id", "start", "text"])

    kind = snippets.schema["media_id"].dataType.simpleString()
    return snippets.groupBy("media_id").applyInPandasWithState(step, f"media_id {kind}, start double, text string", "start double, last double, texts array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def sessions(events: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """Counts of events by session, with a watermark for late ones."""
    return events.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), "n")

