"""Timed snippets: dropping repeats, grouping, rendering."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions.text import timestamp_text

GROUP = "start double, text string"
_END = re.compile(r"[.!?。！？][\"')\]]*$")


def without_repeats(snippets: DataFrame) -> DataFrame:
    """Snippets (media_id, seq, start, text) that say something else than the last
    one kept; blank ones go. The last kept one always says what the one before
    says, so a comparison with that is enough."""
    said = snippets.where(F.trim("text") != "")
    last = F.lag("text").over(W.partitionBy("media_id").orderBy("start", "seq"))
    return said.withColumn("_last", last).where("_last is null or text <> _last").drop("_last")


def pauses(snippets: DataFrame, gap: float) -> DataFrame:
    """Snippets with session_no: a new one begins when the start is ``gap`` seconds
    or more after the one before."""
    by = W.partitionBy("media_id").orderBy("start", "seq")
    new = F.coalesce(F.col("start") - F.lag("start").over(by) >= gap, F.lit(True))
    return snippets.withColumn("session_no", F.sum(new.cast("int")).over(by))


def closed(text: str) -> str:
    """A group's text as a sentence."""
    text = re.sub(r"[,;: ]+$", "", " ".join(text.split()))
    if text and not _END.search(text):
        text += "."
    return text[:1].upper() + text[1:]


class Grouping:
    """Sentence groups of snippets that come in order. A group ends at a pause, at
    a sentence's end once it has lasted ``length`` seconds, or after ``most``
    seconds and three snippets."""

    def __init__(self, length: float = 15.0, most: float = 30.0, pause: float | None = None, state: tuple | None = None):
        self.length, self.most, self.pause = length, most, pause
        self.start, self.last, self.texts = state or (None, None, [])

    def add(self, start: float, text: str) -> Iterator[tuple[float, str]]:
        text = html.unescape(text or "").strip()
        if not text:
            return
        if self.texts and self.pause and start - self.last >= self.pause:
            yield self.flush()
        if not self.texts:
            self.start = start
        self.texts.append(text)
        self.last, lasted = start, start - self.start
        if lasted >= self.length and _END.search(text) or lasted >= self.most and len(self.texts) >= 3:
            yield self.flush()

    def flush(self) -> tuple[float, str]:
        out, self.texts = (self.start, closed(" ".join(self.texts))), []
        return out


def sentence_groups(snippets: DataFrame, length: float = 15.0, most: float = 30.0, pause: float | None = None) -> DataFrame:
    """media_id, group_no, start, text. What ends a group depends on where the one
    before ended, so a medium's snippets are folded in order by one task, which
    Arrow hands them batch by batch: a medium may have any length."""
    kind = snippets.schema["media_id"].dataType.simpleString()

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        medium, state, n = None, None, 0
        for x in frames:
            out = []
            for m, start, text in zip(x.media_id, x.start, x.text, strict=True):
                if state is None or m != medium:
                    if state and state.texts:
                        out.append((medium, n + 1, *state.flush()))
                    medium, state, n = m, Grouping(length, most, pause), 0
                for group in state.add(start, text):
                    n += 1
                    out.append((m, n, *group))
            yield pd.DataFrame(out, columns=["media_id", "group_no", "start", "text"])
        if state and state.texts:
            yield pd.DataFrame([(medium, n + 1, *state.flush())], columns=["media_id", "group_no", "start", "text"])

    dealt = snippets.select("media_id", "seq", "start", "text").repartition("media_id").sortWithinPartitions("media_id", "start", "seq")
    return dealt.mapInPandas(fold, f"media_id {kind}, group_no int, {GROUP}")


def transcript(groups: DataFrame, titles: DataFrame) -> DataFrame:
    """A Markdown document for each medium: title, then a stamped paragraph for
    each group, with links into the player where the medium is a video."""
    stamp = timestamp_text(F.col("start"))
    line = F.when(F.col("video").isNotNull(), F.concat(F.lit("**[["), stamp, F.lit("]](yt://"), F.col("video"), F.lit("?t="), F.floor("start").cast("string"), F.lit(")** "), F.col("text"))).otherwise(F.concat(F.lit("**["), stamp, F.lit("]** "), F.col("text")))
    x = groups.join(titles, "media_id").withColumn("line", line)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("group_no", "line"))), lambda r: r.line), "\n\n")
    return x.groupBy("media_id", "title").agg(body.alias("body"), F.count("*").alias("n_groups"), F.max("start").alias("last_start")).select("media_id", F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.col("body")).alias("text"), "n_groups", "last_start")


def captions(events: DataFrame, json_col: str) -> DataFrame:
    """Snippets from caption files: events with a start in milliseconds and
    segments of text."""
    parsed = F.from_json(json_col, "events array<struct<tStartMs:long,segs:array<struct<utf8:string>>>>")
    x = events.select("media_id", F.posexplode(parsed.events).alias("seq", "e"))
    text = F.array_join(F.transform(F.coalesce(F.col("e.segs"), F.array()), lambda s: F.coalesce(s.utf8, F.lit(""))), "")
    return x.select("media_id", "seq", (F.col("e.tStartMs") / 1000).alias("start"), text.alias("text")).where(F.trim("text") != "")


def preferred(candidates: DataFrame, key: str, ranks: dict[str, int]) -> DataFrame:
    """Of each key's candidates (kind) the one whose kind ranks first, unknown
    kinds last, the earlier seq on ties."""
    rank = F.coalesce(*(F.when(F.col("kind") == k, F.lit(r)) for k, r in ranks.items()), F.lit(1 << 20))
    return candidates.groupBy(key).agg(F.min_by(F.struct("kind", "seq"), F.struct(rank, F.col("seq"))).alias("best")).select(key, "best.kind", "best.seq")


def normalised_audio(clips: DataFrame, samples: str = "samples") -> DataFrame:
    """Samples without their mean, louder by at most ten times up to a peak of
    0.9, and cut at one."""
    n = F.greatest(F.size(samples), F.lit(1))
    mean = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x) / n
    peak = F.aggregate(samples, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x - F.col("mean"))))
    gain = F.when(F.col("peak") > 1e-4, F.least(0.9 / F.col("peak"), F.lit(10.0))).otherwise(1.0)
    out = clips.withColumn("mean", mean).withColumn("peak", peak).withColumn("gain", gain)
    return out.withColumn(samples, F.transform(samples, lambda x: F.greatest(F.least((x - F.col("mean")) * F.col("gain"), F.lit(1.0)), F.lit(-1.0))))
