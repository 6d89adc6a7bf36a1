"""Batch conversion: files of any readable format to files of a target format."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions.html import line_html, row_html
from folio.functions.text import split_row
from folio.functions.tree import markdown_to_json, markdown_to_yaml
from folio.operators.catalog import checked, destinations
from folio.operators.lines import by_line, classified, fenced, lines, slides
from folio.operators.preview import line_heights, on_pages
from folio.operators.tables import grid
from folio.runtime import Scratch
from folio.sources.files import csv_bytes, document, imported, presentation, workbook

#: Documents whose rows are Python values at the same time.
DOCUMENTS = 50
TARGETS = (".md", ".json", ".yaml", ".csv", ".xlsx", ".docx", ".pptx", ".html")


def _gathered(rows: DataFrame, order: str, *cols: str) -> DataFrame:
    """The rows of each document in order, as one array: a file is written whole."""
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(order, *cols))).alias("rows"))


def _packed(rows: DataFrame, pack) -> DataFrame:
    """Files of the rows of documents. A few documents at a time become Python
    values, as their rows take many times the room there that they have in Arrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, DOCUMENTS):
                path, of = b.slice(k, DOCUMENTS).columns
                yield pa.RecordBatch.from_arrays([path, pa.array([pack(r) for r in of.to_pylist()], pa.binary())], ["path", "content"])

    return rows.select(F.col("doc_id").cast("string"), "rows").mapInArrow(run, "path string, content binary")


def exported(docs: DataFrame, ext: str) -> DataFrame:
    """path, content of documents (path, text) in the format of the extension."""
    if ext not in TARGETS:
        raise ValueError(f"can't write {ext}")
    if ext == ".md":
        return docs.select("path", F.col("text").cast("binary").alias("content"))
    if ext in (".json", ".yaml"):
        return docs.select("path", (markdown_to_json if ext == ".json" else markdown_to_yaml)(F.col("text")).cast("binary").alias("content"))
    rows = lines(docs, "path", "text")
    if ext in (".csv", ".xlsx"):
        pack = csv_bytes if ext == ".csv" else workbook
        return _packed(_gathered(grid(rows), "row_no", "cells"), lambda of: pack([list(r["cells"]) for r in of]))
    blocks = classified(fenced(rows))
    if ext in (".docx", ".pptx"):
        bare = F.when(F.col("kind").isin("heading", "bullet", "number"), F.regexp_replace(F.trim("line"), r"^(#{1,6}\s+|[-*+•] |\d+[.)] )", "")).otherwise(F.col("line"))
        # a row of cells keeps the pipes that are escaped in them
        cells = F.when(F.col("kind") == "table", split_row(F.col("line"))).otherwise(F.array(bare))
        shown = blocks.withColumns({"cells": cells, "level": F.coalesce("level", F.lit(0))})
        if ext == ".docx":
            return _packed(_gathered(shown, "line_no", "kind", "level", "cells"), lambda of: document([(r["line_no"], r["kind"], int(r["level"]), list(r["cells"])) for r in of]))
        heights = line_heights(slides(shown)).withColumn("height", F.when(F.col("kind") == "table", 0.4).when(F.col("kind").isin("blank", "separator", "fence"), 0.0).otherwise(F.col("height")))
        return _packed(_gathered(on_pages(heights), "line_no", "slide_no", "page", "kind", "level", "cells"), lambda of: presentation([(int(r["slide_no"]), int(r["page"]), r["kind"], int(r["level"]), list(r["cells"])) for r in of]))
    html = docs.select(F.col("path").alias("doc_id")).join(_gathered(html_islands(blocks), "line_no", "html"), "doc_id", "left")
    body = F.coalesce(F.array_join(F.transform("rows", lambda r: r.html), "\n"), F.lit(""))
    return html.select(F.col("doc_id").alias("path"), F.concat(F.lit('<!DOCTYPE html>\n<html><head><meta charset="utf-8"></head><body>\n'), body, F.lit("\n</body></html>\n")).cast("binary").alias("content"))


#: The element around a run of lines of a kind; others stand alone.
ISLANDS = {"bullet": "ul", "number": "ol", "table": "table", "code": "pre", "quote": "blockquote"}


def html_islands(blocks: DataFrame) -> DataFrame:
    """Classified lines as HTML elements (line_no, html): runs of list items, table
    rows, code and quoted lines are wrapped in one element each. Fences and a
    table's separators end no run."""
    x = blocks.where("kind not in ('fence', 'separator')").withColumn("_around", F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in ISLANDS.items()), F.lit("")))
    begins = (F.col("_around") == "") | ~F.coalesce(F.lag("_around").over(by_line()) == F.col("_around"), F.lit(False))
    x = x.where("kind <> 'blank' or in_code").withColumn("_begins", begins).withColumn("_island", F.sum(F.col("_begins").cast("int")).over(by_line()))
    head = F.col("_begins") & (F.col("kind") == "table")
    x = x.withColumn("html", F.when(F.col("kind") == "table", row_html(split_row(F.col("line")), head)).otherwise(line_html(F.col("kind"), F.col("level"), F.col("line"))))
    inner = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "html"))), lambda r: r.html), "\n")
    runs = x.groupBy("doc_id", "_island", "_around").agg(F.min("line_no").alias("line_no"), inner.alias("html"))
    tag = F.col("_around")
    code = F.concat(F.lit("<pre><code>"), "html", F.lit("</code></pre>"))
    around = F.concat(F.lit("<"), tag, F.lit(">\n"), "html", F.lit("\n</"), tag, F.lit(">"))
    return runs.select("doc_id", "line_no", F.when(tag == "", F.col("html")).when(tag == "pre", code).otherwise(around).alias("html"))


def packaged(made: DataFrame, by: str = "batch") -> DataFrame:
    """by, content: one zip archive of the outputs (output, content) of each batch,
    in the order of their names. An archive is written by one task, as it is one file."""

    def pack(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, raw in sorted(zip(x.output, x.content, strict=True)):
                z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), bytes(raw), zipfile.ZIP_DEFLATED)
        return pd.DataFrame({by: [key[0]], "content": [out.getvalue()]})

    return made.where("content is not null").select(by, "output", "content").groupBy(by).applyInPandas(pack, f"{by} {made.schema[by].dataType.simpleString()}, content binary")


def converted(found: DataFrame, ext: str) -> DataFrame:
    """path, output, status, error, content of files (path, length, content).

    Files are checked and read in one pass and written one by one, so a bad one only
    costs its own row; those that have the target format already are copied as
    they are. What has been read is written down once, for what is made of it and
    for the list of errors.
    """
    plan = destinations(found.select("path", F.xxhash64("path").alias("scan_no")), ext).select(F.col("path").alias("_path"), "output")
    x = checked(found.select("path", "length", "content"))
    whole = F.col("problem").isNull() & (F.col("ext") == ext)
    x = x.select("path", F.when(~whole | F.col("problem").isNotNull(), F.col("content")).alias("content"), F.when(whole, F.col("content")).alias("copy"), "problem", whole.alias("whole"))
    read = Scratch(found.sparkSession, "convert").save(imported(x), "read")
    made = exported(read.where("text is not null").select("path", "text"), ext).select(F.col("path").alias("_made"), F.col("content").alias("made"))
    # what is written has no known size, so contents are sorted to their rows, never broadcast
    out = read.drop("text").join(made.hint("merge"), F.col("path") == F.col("_made"), "left").join(plan.hint("merge"), F.col("path") == F.col("_path"))
    return out.select("path", "output", F.when(F.col("error").isNull(), "success").otherwise("failed").alias("status"), "error", F.coalesce("copy", "made").alias("content"))
