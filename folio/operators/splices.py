"""Edits of documents as rows: where several passes want to change a text, which of
them do, and the text made of it once."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import strip, timestamp_seconds
from folio.operators.images import image_tokens
from folio.operators.ranks import folded
from folio.runtime import Scratch

#: Characters of a text in a bin of ranges.
BIN = 4096
EDIT = "doc_id, priority, start, end, new"
#: Diagrams, images, stamps and breaks of a preview.
DIAGRAM, STAMP, BREAK = r"(?<!`)`{3,4}mermaid[^\n]*\n([\s\S]*?)\n\s*`{3,4}", r"\*\*\[(\d{1,2}:\d{2}(?::\d{2})?)\]\*\*(?!\()", r"(?i)<br\s*/?>"


def ranges(docs: DataFrame, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, end (code points, from 0) and the first group of each match,
    in Python's regular expressions. Texts are searched one by one."""

    @F.arrow_udf("array<struct<start:int,end:int,found:string>>")
    def found(x: pa.Array) -> pa.Array:
        of, kind = re.compile(pattern), pa.struct([("start", pa.int32()), ("end", pa.int32()), ("found", pa.string())])
        return pa.array([[{"start": m.start(), "end": m.end(), "found": m[1] if m.re.groups else m[0]} for m in of.finditer(t or "")] for t in x.to_pylist()], pa.list_(kind))

    return docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.explode(found(text_col)).alias("m")).select("doc_id", "m.*")


class FirstFit:
    """Of ranges (start, end) in order those that begin where the last one taken has
    ended, or later.

    Whatever a stretch begins with, only the end of the last one taken counts; the
    chains from all its ranges flow together, so few different ends are left of a
    stretch, with the starts from which each is reached.
    """

    begin = 0

    def summary(self, rows: Iterator[tuple]) -> tuple[list[int], list[int]]:
        of = list(rows)
        starts, last = [s for s, _ in of], [0] * len(of)
        for k in range(len(of) - 1, -1, -1):
            # the next one that fits after this
            j = max(k + 1, bisect_left(starts, of[k][1]))
            last[k] = last[j] if j < len(of) else of[k][1]
        keep = [k for k in range(len(of)) if k + 1 == len(of) or last[k] != last[k + 1]]
        return [starts[k] for k in keep], [last[k] for k in keep]

    def after(self, end: int, summary: tuple[list[int], list[int]]) -> int:
        starts, last = summary
        k = bisect_left(starts, end)
        return last[k] if k < len(starts) else end

    def outputs(self, end: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        for s, e in rows:
            fits = s >= end
            end = e if fits else end
            yield (fits,)


def _bins(rows: DataFrame, name: str) -> DataFrame:
    last = F.greatest(F.col("start"), F.col("end") - 1)
    return rows.withColumn(name, F.explode(F.sequence(F.floor(F.col("start") / BIN), F.floor(last / BIN))))


def chosen(edits: DataFrame) -> DataFrame:
    """The edits (EDIT, start and end from 0 in code points) that are made.

    Those of a lower priority number come first. An edit that overlaps one of them
    isn't made; touching is no overlap, and an empty range, an insertion, overlaps
    what it lies inside of. Of edits of one priority the earlier one is made, at one
    start insertions, then the longest, then by their new text. Edits that repeat
    one are made once; ranges without an end or turned around are left out.

    Each priority is settled with the ones before by bins of the text, so ranges
    only meet those nearby, and within itself by a fold over ranges of rows: a
    document may have any number of edits.
    """
    scratch = Scratch(edits.sparkSession, "edits")
    x = scratch.save(edits.select(*EDIT.split(", ")).where("doc_id is not null and start >= 0 and end >= start and priority is not null").distinct(), "edits")
    made: list[DataFrame] = []
    for (priority,) in x.select("priority").distinct().orderBy("priority").collect():  # a number for each pass
        here = x.where(F.col("priority") == priority)
        if made:
            before = _bins(reduce(DataFrame.unionByName, made), "_bin").select(F.col("doc_id").alias("_d"), F.col("start").alias("_s"), F.col("end").alias("_e"), "_bin")
            hit = _bins(here, "bin").join(before, (F.col("doc_id") == F.col("_d")) & (F.col("bin") == F.col("_bin")) & (F.col("_s") < F.col("end")) & (F.col("start") < F.col("_e")), "left_semi")
            here = here.join(hit.select("doc_id", "start", "end").distinct(), ["doc_id", "start", "end"], "left_anti")
        order = ["start", (F.col("end") > F.col("start")).cast("int"), F.desc("end"), "new"]
        fits = folded(here, ["doc_id"], order, ["start", "end"], FirstFit(), "fits boolean")
        made.append(scratch.save(fits.where("fits").select(*EDIT.split(", ")), f"made-{len(made)}"))
    return reduce(DataFrame.unionByName, made) if made else x


def spliced(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with edits that don't overlap made in their texts (a range's end is cut
    at the text's). A text's edits are gathered, as they are all of one row, and it
    is put together once. Ids name documents; rows that share one get its edits each."""

    @F.arrow_udf("string")
    def put(texts: pa.Array, edits: pa.Array) -> pa.Array:
        out = []
        for t, es in zip(texts.to_pylist(), edits.to_pylist(), strict=True):
            if t is None or not es:
                out.append(t)
                continue
            parts, at = [], 0
            for e in es:
                parts += [t[at : e["start"]], e["new"] or ""]
                at = e["end"]
            out.append("".join([*parts, t[at:]]))
        return pa.array(out, pa.string())

    of = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "new"))).alias("_edits")).withColumnRenamed("doc_id", "_d")
    x = docs.join(of, F.col(id_col) == F.col("_d"), "left")
    return x.withColumn(text_col, put(F.col(text_col), F.col("_edits"))).select(*docs.columns)


def picture_link(alt: Column, uri: Column, src: Column, idx: Column, start: Column, align: Column) -> Column:
    """An image that can be clicked on, in a paragraph if it is aligned."""
    quoted = F.replace(F.replace(F.url_encode(src), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    md = F.concat(F.lit("[!["), alt, F.lit("]("), uri, F.lit(")](imgaction://select?src="), quoted, F.lit("&idx="), idx.cast("string"), F.lit("&start="), start.cast("string"), F.lit(")"))
    side = F.lower(strip(F.coalesce(align, F.lit(""))))
    return F.when(side.isin("center", "right", "left"), F.concat(F.lit('<p align="'), side, F.lit('">'), md, F.lit("</p>"))).otherwise(md)


def preview_edits(docs: DataFrame, assets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The edits that make a text its preview: diagrams become pictures of a
    renderer, images links to their assets' (src, uri) pictures, stamps of texts
    that name a video links into it, and breaks line ends, in table rows U+2028.
    Positions are those of the text as it is; what stands in code stays."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    edit = lambda rows, priority, new: rows.select("doc_id", F.lit(priority).alias("priority"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), new.alias("new"))
    code = F.concat(F.lit("![Mermaid Diagram](https://mermaid.ink/img/"), F.base64(F.to_json(F.struct(F.col("found").alias("code"))).cast("binary")), F.lit(")"))
    drawn = edit(ranges(d.where(F.lower("text").contains("```mermaid")), DIAGRAM), 0, code)
    # what stands in other code is held against all later passes, and stays as it is
    fences = ranges(d.where(F.col("text").contains("```")), r"(?m)^[ \t]*(```[^\n]*\n(?:[\s\S]*?\n)?[ \t]*```)")
    kept = edit(fences, 1, F.lit(None).cast("string"))
    tokens = image_tokens(d).join(assets.select(F.col("src").alias("_src"), "uri"), F.col("src") == F.col("_src"), "left")
    alt = F.coalesce(F.nullif(F.col("alt"), F.lit("")), F.lit("image"))
    images = edit(tokens, 2, picture_link(alt, F.coalesce("uri", "src"), F.col("src"), F.col("token_no"), F.col("start"), F.col("align")))
    video = F.nullif(F.regexp_extract("text", r"(?:youtube\.com/watch\?v=|youtu\.be/|yt://)([a-zA-Z0-9_-]{11})", 1), F.lit(""))
    videos = d.select(F.col("doc_id").alias("_v"), video.alias("video")).where("video is not null")
    stamps = ranges(d.where(video.isNotNull()), STAMP).join(videos, F.col("doc_id") == F.col("_v"))
    stamped = edit(stamps, 3, F.concat(F.lit("**[[⏱️ "), "found", F.lit("]](yt://"), "video", F.lit("?t="), timestamp_seconds(F.col("found")).cast("string"), F.lit(")**")))
    rows = ranges(d.where(F.lower("text").contains("<br")), r"(?im)^[ \t]*\|.*\|[ \t]*$")
    inner = ranges(d.where(F.lower("text").contains("<br")), BREAK)
    binned = _bins(rows, "bin").select(F.col("doc_id").alias("_r"), F.col("start").alias("a"), F.col("end").alias("b"), F.col("bin").alias("_bin"))
    met = inner.withColumn("bin", F.floor(F.col("start") / BIN)).join(binned, (F.col("doc_id") == F.col("_r")) & (F.col("bin") == F.col("_bin")) & (F.col("start") >= F.col("a")) & (F.col("end") <= F.col("b")), "left")
    broken = edit(met, 4, F.when(F.col("a").isNotNull(), F.lit(" ")).otherwise(F.lit("\n")))
    return reduce(DataFrame.unionByName, [drawn, kept, images, stamped, broken])


def previews(docs: DataFrame, assets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the texts that are shown: preview_edits(), overlaps resolved."""
    made = chosen(preview_edits(docs, assets, id_col, text_col)).where("new is not null")
    return spliced(docs, made, id_col, text_col)
