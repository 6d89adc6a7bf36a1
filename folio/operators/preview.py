"""Getting Markdown ready to be shown, exported or put on slides."""

from __future__ import annotations

import re
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions.text import strip, timestamp_seconds, video_id
from folio.operators.lines import by_line, carried

#: Extensions of media types.
MEDIA = {"audio/mpeg": ".mp3", "audio/mp4": ".m4a", "audio/wav": ".wav", "audio/x-wav": ".wav", "audio/ogg": ".ogg", "audio/flac": ".flac", "video/mp4": ".mp4", "video/webm": ".webm", "video/quicktime": ".mov", "video/x-matroska": ".mkv"}


def breaks_shown(rows: DataFrame) -> DataFrame:
    """Lines (with in_code) whose <br> tags are line ends: a separator sign inside
    table rows, a new line elsewhere; code stays as it is."""
    to = F.when(strip(F.col("line")).startswith("|"), F.lit(" ")).otherwise(F.lit("\n"))
    return rows.withColumn("line", F.when(F.col("in_code") | ~F.lower("line").contains("<br"), F.col("line")).otherwise(F.regexp_replace(F.col("line"), F.lit(r"(?i)<br\s*/?>"), to)))


def stamps_linked(rows: DataFrame) -> DataFrame:
    """Lines of documents that name a video, with the stamp at their start as a
    link into the player."""
    video = F.max(video_id(F.regexp_extract("line", r"(https?://\S*(?:youtube\.com|youtu\.be)/[^\s)]*)", 1))).over(W.partitionBy("doc_id"))
    stamp = F.regexp_extract("line", r"^\*\*\[(\d{1,3}:\d{2}(?::\d{2})?)\]\*\*", 1)
    link = F.concat(F.lit("**[["), F.col("_stamp"), F.lit("]](yt://"), F.col("_video"), F.lit("?t="), timestamp_seconds(F.col("_stamp")).cast("string"), F.lit(")**"), F.substring(F.col("line"), F.length("_stamp") + 7, F.lit(1 << 30)))
    x = rows.withColumns({"_video": video, "_stamp": stamp})
    return x.withColumn("line", F.when((F.col("_stamp") != "") & F.col("_video").isNotNull(), link).otherwise(F.col("line"))).drop("_video", "_stamp")


def video_and_title(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first video that a document names, and its first title."""
    url = F.regexp_extract(text_col, r"(https?://\S*(?:youtube\.com|youtu\.be)/[^\s)]*)", 1)
    return docs.select(F.col(id_col).alias("doc_id"), video_id(url).alias("video"), F.nullif(F.regexp_extract(text_col, r"(?m)^#\s+(.+)$", 1), F.lit("")).alias("title"))


def default_name(text: Column) -> Column:
    """A file name from a document's first heading."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_extract(text, r"(?m)^#+\s+(.+)$", 1), r'[<>:"/\\|?*]', "")), 1, 100)


def guessed_extension(mime: Column, name: Column) -> Column:
    """The extension of a download: by its type, else its name, else .mp4."""
    by_type = F.coalesce(*(F.when(F.lower(F.regexp_extract(mime, r"^\s*([^;\s]+)", 1)) == k, F.lit(v)) for k, v in MEDIA.items()))
    return F.coalesce(by_type, F.nullif(F.lower(F.regexp_extract(name, r"(\.[A-Za-z0-9]{2,4})$", 1)), F.lit("")), F.lit(".mp4"))


def line_heights(rows: DataFrame) -> DataFrame:
    """Lines (level from 0) with the lines that they take on a slide and their
    height in inches: 75 characters a line, five fewer a level, 35 at least."""
    shown = F.greatest(F.lit(1), F.ceil(F.length("line") / F.greatest(F.lit(35), 75 - 5 * F.col("level"))))
    return rows.withColumn("visual_lines", shown.cast("int")).withColumn("height", F.round(0.26 * F.col("visual_lines") + 0.18, 2))


def slide_pages(heights: DataFrame, most: float = 5.0) -> DataFrame:
    """Lines (slide_no, line_no, height) with the page of their slide: a new one
    begins where the height would pass ``most``. Pages depend on where the one
    before broke; lines come in order and only a sum is held."""

    return on_pages(heights.select("doc_id", "slide_no", "line_no", "height"), most).drop("height")


def on_pages(heights: DataFrame, most: float = 5.0) -> DataFrame:
    """slide_pages() with all columns of the lines."""

    def page(state: list, doc: object, slide: object, height: float | None) -> int:
        height = height or 0.0
        if state[:2] != [doc, slide]:
            state[:] = [doc, slide, 1, 0.0]
        elif state[3] + height > most:
            state[2:] = [state[2] + 1, 0.0]
        state[3] += height
        return state[2]

    dealt = heights.repartition("doc_id", "slide_no").sortWithinPartitions("doc_id", "slide_no", "line_no")
    return carried(dealt, heights.columns, ["doc_id", "slide_no", "height"], page, "page", T.IntegerType())


def fences_repaired(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents whose code fences open and close: code on the opening line goes
    below it, a fence left open is closed before a heading or at the end. Python
    only gets texts with a fence."""

    @F.pandas_udf("string")
    def repair(x: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if text is None or "```" not in text:
                return text
            out, open_ = [], False
            for line in text.split("\n"):
                m = re.match(r"(\s*)```(\w*)[ \t]*(.*)$", line)
                if m and not open_:
                    out.append(f"{m[1]}```{m[2]}")
                    body = m[3]
                    if body.endswith("```"):
                        out += [body[:-3].rstrip(), f"{m[1]}```"]
                    else:
                        out += [body] if body else []
                        open_ = True
                elif m:
                    out.append(f"{m[1]}```")
                    out += [line[m.end(1) + 3 :].strip()] if line[m.end(1) + 3 :].strip() else []
                    open_ = False
                elif open_ and re.match(r"#{1,6} \S", line) and out[-1].strip() == "":
                    out += ["```", "", line]
                    open_ = False
                else:
                    out.append(line)
            return "\n".join([*out, "```"] if open_ else out)

        return x.map(one)

    fenced = F.col(text_col).contains("```")
    return docs.withColumn(text_col, F.when(fenced, repair(F.when(fenced, F.col(text_col)))).otherwise(F.col(text_col)))


def blocks(docs: DataFrame, tokens: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as alternating stretches of text and images, in order."""
    by = W.partitionBy("doc_id").orderBy("start")
    t = tokens.select("doc_id", "start", "end", "src", "align")
    gaps = t.withColumn("from", F.coalesce(F.lag("end").over(by), F.lit(0))).select("doc_id", F.col("from").alias("start"), F.col("start").alias("end"))
    last = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.length(text_col), F.lit(0)).alias("n")).join(t.groupBy("doc_id").agg(F.max("end").alias("e")), "doc_id", "left")
    rest = last.select("doc_id", F.coalesce("e", F.lit(0)).alias("start"), F.col("n").alias("end"))
    text = gaps.unionByName(rest).where("end > start").join(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t")), "doc_id")
    text = text.select("doc_id", "start", F.lit("text").alias("kind"), F.substring(F.col("_t"), F.col("start") + 1, F.col("end") - F.col("start")).alias("value"), F.lit("").alias("align"))
    every = text.where(strip(F.col("value")) != "").unionByName(t.select("doc_id", "start", F.lit("image").alias("kind"), F.col("src").alias("value"), "align"))
    return every.withColumn("block_no", F.row_number().over(by))


def merged_columns(tables: DataFrame) -> DataFrame:
    """Tables (doc_id, table_no, row_no, cells) with neighbouring columns joined
    that are never both filled, as often as that goes. A table's rows are one
    group, as they stand on one page or in one document."""

    def merge(x: pd.DataFrame) -> pd.DataFrame:
        rows = [list(r) for r in x.sort_values("row_no").cells]
        width = max(map(len, rows), default=0)
        rows = [r + [""] * (width - len(r)) for r in rows]
        k = 0
        while k + 1 < width:
            if all(not (r[k].strip() and r[k + 1].strip()) for r in rows):
                for r in rows:
                    r[k : k + 2] = [(r[k] + r[k + 1]).strip()]
                width, k = width - 1, 0
            else:
                k += 1
        return x.sort_values("row_no").assign(cells=rows)[["doc_id", "table_no", "row_no", "cells"]]

    kinds = ", ".join(f"{c} {tables.schema[c].dataType.simpleString()}" for c in ("doc_id", "table_no", "row_no"))
    return tables.select("doc_id", "table_no", "row_no", "cells").groupBy("doc_id", "table_no").applyInPandas(merge, f"{kinds}, cells array<string>")


def wrapped_lines_joined(rows: DataFrame) -> DataFrame:
    """Lines with paragraph_no: one that begins in lower case goes on with the line
    before, unless a blank line or a block stands between."""
    s = strip(F.col("line"))
    before = F.lag(s).over(by_line())
    goes_on = s.rlike(r"^\p{Ll}") & (before != "") & ~before.rlike(r"^(#|[-*•] |\d+[.)] |\|)") & ~before.rlike(r"[.!?:]$")
    return rows.withColumn("paragraph_no", F.sum((~F.coalesce(goes_on, F.lit(False))).cast("int")).over(by_line()))


def batches(rows: DataFrame, order: str, size: int = 25) -> DataFrame:
    """Paragraphs of each document in batches, joined by a mark that their
    translation is divided at again."""
    n = F.row_number().over(W.partitionBy("doc_id").orderBy(order)) - 1
    x = rows.withColumn("batch_no", F.floor(n / size).cast("int"))
    return x.groupBy("doc_id", "batch_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda r: r.line), "\n<<<SEG>>>\n").alias("text"), F.count("*").alias("n"))
