"""Markdown tables: finding, parsing, checking, rendering."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions.text import csv_cell, is_separator, pad, rule_line, split_row, strip, table_line
from folio.operators.lines import by_line
from folio.operators.ranks import folded, running
from folio.runtime import Scratch


def table_lines(rows: DataFrame, compat: bool = True, least: int = 2) -> DataFrame:
    """Lines to table rows: doc_id, table_no, table_name, row_no, cells.

    A table is a run of lines with a pipe. Separator lines aren't rows (in compat
    mode wherever they stand, else as the second line only); with ``least`` rows or
    more the table counts. Its name is the nearest of the four lines before it that is
    a heading, made fit for a sheet, or else Sheet and its number.
    """
    island = F.sum((~F.col("line").contains("|")).cast("int")).over(by_line())
    heading = F.when(F.col("line").startswith("#"), F.substring(F.regexp_replace(F.regexp_replace("line", r"^#+\s*", ""), r"[\\/?*\[\]:]", "_"), 1, 31))
    named = F.last(heading, ignorenulls=True).over(by_line().rowsBetween(-4, -1))
    x = rows.withColumns({"island": island, "name": named}).where("line like '%|%'")
    of = W.partitionBy("doc_id", "island").orderBy("line_no")
    sep = is_separator(F.col("line"))
    if not compat:
        x = x.withColumn("_at", F.row_number().over(of))
        sep = sep & (F.col("_at") == 2)
    x = x.where(~sep).withColumns({"row_no": F.row_number().over(of), "cells": split_row(F.col("line"), compat)})
    whole = W.partitionBy("doc_id", "island")
    x = x.withColumns({"n_rows": F.count("*").over(whole), "width": F.max(F.size("cells")).over(whole), "name": F.first("name").over(of)}).where(F.col("n_rows") >= least)
    x = x.withColumn("table_no", F.dense_rank().over(W.partitionBy("doc_id").orderBy("island")))
    name = F.coalesce(F.nullif(strip(F.col("name")), F.lit("")), F.concat(F.lit("Sheet"), F.col("table_no").cast("string")))
    return x.select("doc_id", "table_no", name.alias("table_name"), "row_no", pad(F.col("cells"), F.col("width")).alias("cells"))


def cells(tables: DataFrame) -> DataFrame:
    return tables.select("doc_id", "table_no", "table_name", "row_no", F.posexplode("cells").alias("col_no", "cell"))


def table_warnings(rows: DataFrame) -> DataFrame:
    """What is wrong with tables: a run of one line, a second line that isn't a
    separator, and rows whose number of cells isn't the header's."""
    x = rows.withColumn("island", F.sum((~F.col("line").contains("|")).cast("int")).over(by_line())).where("line like '%|%'")
    of = W.partitionBy("doc_id", "island").orderBy("line_no")
    x = x.withColumns({"at": F.row_number().over(of), "n": F.count("*").over(W.partitionBy("doc_id", "island")), "width": F.size(split_row(F.col("line"))), "sep": is_separator(F.col("line"))})
    x = x.withColumn("header", F.first("width").over(of))
    kind = F.when((F.col("n") == 1) & ~F.col("sep"), "incomplete").when((F.col("at") == 2) & ~F.col("sep"), "separator").when(~F.col("sep") & (F.col("width") != F.col("header")), "columns")
    return x.withColumn("warning", kind).where("warning is not null").select("doc_id", "line_no", "warning", "width", "header")


def rendered(rows: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """One Markdown table of the columns for each key, rows in the given order.
    A table is built by one task, as it becomes one document."""
    line = table_line(F.array(*(F.col(c).cast("string") for c in columns)))
    body = F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))), lambda r: r["_line"])
    head = F.concat(table_line(F.array(*map(F.lit, columns))), F.lit("\n"), rule_line(F.lit(len(columns))))
    return rows.groupBy(*key).agg(F.concat(head, F.lit("\n"), F.array_join(body, "\n")).alias("text"))


def record_table(records: DataFrame, id_col: str, map_col: str) -> DataFrame:
    """Records (maps of texts) to aligned rows: the columns are all keys, in the
    order in which they are first seen, and a record without one has an empty cell.

    Keys are numbered in a written table; the cells that there are meet them by
    key, so what moves grows with the cells, and a record's row is filled up to
    the number of keys. Keys that only some records have cost those records
    nothing but the empty cells of the result. A record whose id is another's or
    null has a row of its own, null ids last; an empty or null map gives empty
    cells. Of a key that a map has more than once, as one read from JSON may, the
    first value counts.
    """
    scratch = Scratch(records.sparkSession, "records")
    names = F.map_keys(map_col)
    firsts = F.map_from_entries(F.filter(F.map_entries(map_col), lambda e, i: F.array_position(names, e["key"]) == i + 1))
    once = F.when(F.size(F.array_distinct(names)) < F.size(names), firsts).otherwise(F.col(map_col))
    rows = scratch.save(records.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("uid"), once.alias("m")), "records")
    each = rows.select("id", "uid", F.posexplode(F.map_keys("m")).alias("at", "key"))
    keys = each.groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "at")).alias("first"))
    keys = scratch.save(running(keys, [], ["first", "key"]).select(F.col("key").alias("k"), (F.col("place") - 1).cast("int").alias("col_no")), "keys")
    width = keys.count()
    cell = F.replace(F.regexp_replace(F.coalesce("value", F.lit("")), r"\r?\n", " "), F.lit("|"), F.lit("\\|"))
    cells = rows.select("uid", F.explode("m").alias("key", "value")).join(keys, F.col("key") == F.col("k"))
    cells = cells.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("col_no", cell.alias("cell")))).alias("of")).withColumnRenamed("uid", "u")
    filled = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.element_at("of", i), F.lit(""))) if width else F.array().cast("array<string>")
    header = F.broadcast(keys.agg(F.transform(F.array_sort(F.collect_list(F.struct("col_no", "k"))), lambda x: x.k).alias("header")))  # a row as wide as each of the result's
    return rows.join(cells, F.col("uid") == F.col("u"), "left").join(header).select(F.col("id").alias(id_col), "header", filled.alias("cells"))


def grid(rows: DataFrame, clean: bool = True) -> DataFrame:
    """Lines as spreadsheet rows: table rows as cells, headings and other lines in
    the first column, separators dropped, blank lines kept as empty rows. Where only
    the shape is wanted, cells needn't be cleaned."""
    s = strip(F.col("line"))
    kept = rows.where(~(s.contains("|") & is_separator(s)))
    kind = F.when(s == "", "empty").when(s.contains("|"), "data").when(s.rlike(r"^#{1,6}\s+\S"), "heading").otherwise("text")
    x = kept.withColumns({"kind": kind, "island": F.sum((~F.col("line").contains("|")).cast("int")).over(by_line())})
    first = F.row_number().over(W.partitionBy("doc_id", "island", "kind").orderBy("line_no")) == 1
    x = x.withColumn("kind", F.when((F.col("kind") == "data") & first, "header").otherwise(F.col("kind")))
    inner = F.transform(F.split(F.regexp_replace(s, r"^\||\|$", ""), r"\|"), csv_cell) if clean else F.split(F.regexp_replace(s, r"^\||\|$", ""), r"\|")
    made = F.when(F.col("kind").isin("data", "header"), inner).when(F.col("kind") == "heading", F.array(F.regexp_replace(s, r"^#+\s+", ""))).when(F.col("kind") == "text", F.array(csv_cell(F.col("line")) if clean else F.col("line"))).otherwise(F.array().cast("array<string>"))
    return x.select("doc_id", F.row_number().over(by_line()).alias("row_no"), "kind", made.alias("cells"))


def sheet_size(sheet: DataFrame) -> DataFrame:
    """Rows (without blank ones at the end) and columns of each grid."""
    return sheet.groupBy("doc_id").agg(F.max(F.when(F.size("cells") > 0, F.col("row_no"))).alias("n_rows"), F.max(F.size("cells")).alias("n_cols"))


def column_widths(sheet: DataFrame, most: int = 60) -> DataFrame:
    """Characters to show of each column."""
    each = sheet.select("doc_id", F.posexplode("cells").alias("col_no", "cell"))
    return each.groupBy("doc_id", "col_no").agg(F.least(F.max(F.length("cell")) + 5, F.lit(most)).alias("width"))


def looks_like_prose(cells: Column) -> Column:
    """Guards against tables that are none: fewer than two columns, a long first
    cell, words cut in two, mostly short words."""
    text = F.array_join(cells, " ")
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    n = F.greatest(F.size(words), F.lit(1))
    short = F.size(F.filter(words, lambda w: F.length(w) <= 2)) / n
    mean = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w)) / n
    return (F.size(cells) < 2) | (F.size(F.split(cells[0], r"\s+")) > 15) | ((short > 0.35) & (mean < 3.5)) | F.exists(cells, lambda c: (F.length(c) > 20) & F.exists(cells, lambda d: strip(d) == ""))


def without_empty_columns(tables: DataFrame) -> DataFrame:
    """Table rows, their cells trimmed and null ones empty, without the columns that
    are empty in each row of their table."""
    each = cells(tables).withColumn("cell", strip(F.coalesce("cell", F.lit("")))).withColumn("used", F.max(F.col("cell") != "").over(W.partitionBy("doc_id", "table_no", "col_no"))).where("used")
    return each.groupBy("doc_id", "table_no", "table_name", "row_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_no", "cell"))), lambda x: x.cell).alias("cells"))


def columns_by_overlap(above: DataFrame, below: DataFrame) -> DataFrame:
    """Cells of a continued table to the columns above them: (doc_id, cell_no,
    col_no) with the widest common stretch, the leftmost column on ties."""
    pairs = below.alias("b").join(above.alias("a"), (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("b.x0") < F.col("a.x1")) & (F.col("a.x0") < F.col("b.x1")))
    common = F.least("a.x1", "b.x1") - F.greatest("a.x0", "b.x0")
    x = pairs.select(F.col("b.doc_id").alias("doc_id"), "cell_no", "col_no", common.alias("overlap"))
    return x.groupBy("doc_id", "cell_no").agg(F.max_by("col_no", F.struct("overlap", -F.col("col_no"))).alias("col_no"), F.max("overlap").alias("overlap"))


def stitched(elements: DataFrame, limit: int = 150) -> DataFrame:
    """Tables that go on over page breaks get one group number: neighbours of one
    document with as many columns, a page break and fewer than ``limit`` characters
    of text between them. elements: doc_id, elem_no, type, n_chars, n_cols."""
    return headed_runs(elements, limit).drop("head")


def headed_runs(elements: DataFrame, limit: int = 150) -> DataFrame:
    """stitched() with head, the first element of each group."""
    by = W.partitionBy("doc_id").orderBy("elem_no")
    x = elements.withColumns({"chars": F.sum(F.when(F.col("type") == "text", F.col("n_chars")).when(F.col("type") == "image", 9999).otherwise(0)).over(by), "breaks": F.sum((F.col("type") == "page_break").cast("int")).over(by)}).where("type = 'table'")
    goes_on = (F.col("n_cols") == F.lag("n_cols").over(by)) & (F.col("breaks") > F.lag("breaks").over(by)) & (F.col("chars") - F.lag("chars").over(by) < limit)
    x = x.withColumn("_new", ~F.coalesce(goes_on, F.lit(False)))
    return x.select("doc_id", "elem_no", F.sum(F.col("_new").cast("int")).over(by).alias("table_no"), "n_cols", F.max(F.when(F.col("_new"), F.col("elem_no"))).over(by).alias("head"))


class Continued:
    """Rows of a run of tables that go on with the row before, as it is by then.

    A row is (first, filled, ends): whether it is the first of a table that
    continues another, which cells aren't empty, and whether the last one ends a
    sentence. A first row with an empty first cell goes on if it fills a later
    cell that the row before has empty, or if both have a last cell and that of
    the row before doesn't end a sentence. What such rows make of a state depends
    on it only up to the first row that can't go on, so a stretch is summed up by
    the rows before that one, the state at its end and the rows begun after it.
    """

    begin = (None, None, 0)

    @staticmethod
    def step(state: tuple, row: tuple) -> tuple:
        (filled, ended, n), (first, own, ends) = state, row
        if first and filled is not None and len(own) == len(filled) > 1 and not own[0]:
            if any(b and not a for a, b in zip(filled[1:], own[1:], strict=True)) or filled[-1] and own[-1] and not ended:
                return [a or b for a, b in zip(filled, own, strict=True)], ends if own[-1] else ended, n
        return own, ends, n + 1

    def summary(self, rows: Iterator[tuple]) -> tuple[list[tuple], tuple | None]:
        open_: list[tuple] = []
        for row in rows:
            if not row[0] or len(row[1]) < 2 or row[1][0]:
                state = self.step((None, None, 0), row)
                break
            open_.append(row)
        else:
            return open_, None
        for row in rows:
            state = self.step(state, row)
        return open_, state

    def after(self, state: tuple, summary: tuple) -> tuple:
        for row in summary[0]:
            state = self.step(state, row)
        return state if summary[1] is None else (*summary[1][:2], state[2] + summary[1][2])

    def outputs(self, state: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        for row in rows:
            state = self.step(state, row)
            yield (state[2],)


def joined(elements: DataFrame, columns: DataFrame, rows: DataFrame, limit: int = 150) -> DataFrame:
    """doc_id, table_no, row_no and cells of tables that go on over page breaks, as
    one table each (stitched()).

    elements: doc_id, elem_no, type, n_chars, n_cols; columns: doc_id, elem_no,
    col_no from 0, x0, x1; rows: doc_id, elem_no, row_no, cells. The cells of a
    continued table go to the columns of the first table of its run, each to that
    which its own column shares the widest stretch with, the leftmost on ties; of
    several cells for one column the last stays, one that meets none is dropped. A
    continued table's first row is added to the row before where that goes on
    (Continued). Null cells are empty; a table without rows has no part; a null
    doc_id is a document.

    Column maps are arrays of a table's width. Rows that belong together are told
    by a fold over ranges (ranks.folded), so a run of any number of rows and
    tables is spread.
    """
    scratch = Scratch(rows.sparkSession, "joined")
    # structs of nulls are equal, so one key is plain to join, group and deal out by
    key = F.struct("doc_id", "elem_no").alias("key")
    runs = headed_runs(elements, limit).select(key, "table_no", "head")
    span = F.struct("col_no", "x0", "x1")
    each = columns.select(key, span.alias("span"), F.lit(None).cast(rows.schema["row_no"].dataType).alias("row_no"), F.lit(0).alias("is_row"))
    each = each.union(rows.select(key, F.lit(None).cast(each.schema["span"].dataType).alias("span"), "row_no", F.lit(1).alias("is_row")))
    parts = each.groupBy("key").agg(F.array_sort(F.collect_list("span")).alias("spans"), F.min("row_no").alias("first"), F.sum("is_row").alias("n"))
    x = parts.where(F.size("spans") > 0).join(runs, "key").select("key", "table_no", "spans", "first", "n", F.col("key.elem_no").eqNullSafe(F.col("head")).alias("is_head"), F.col("key.doc_id").alias("doc_id"))
    # a table's first element comes before all others of its run
    of_head = W.partitionBy("doc_id", "table_no").orderBy(F.col("is_head").desc(), "key").rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("above", F.first(F.when(F.col("is_head"), F.col("spans")), ignorenulls=True).over(of_head)).where("above is not null")
    common = lambda a, b: F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    shared = lambda b: F.transform("above", lambda a: common(a, b))
    best = F.transform("spans", lambda b: F.transform(F.array(shared(b)), lambda c: F.when(F.array_max(c) > 0, F.array_position(c, F.array_max(c)) - 1).otherwise(-1))[0])
    maps = scratch.save(x.select("key", "table_no", (~F.col("is_head")).alias("child"), F.when(~F.col("is_head"), best).alias("to"), F.size("above").alias("width"), "first", "n"), "maps")
    given = F.transform(F.coalesce("cells", F.array().cast("array<string>")), lambda c: F.coalesce(c, F.lit("")))
    x = rows.select(key, "row_no", given.alias("cells")).join(maps, "key").select("key.doc_id", "key.elem_no", "row_no", "cells", "table_no", "child", "to", "width", "first")
    from_ = lambda i: F.array_max(F.filter(F.transform("to", lambda t, j: F.when(t == i, j)), lambda j: j.isNotNull() & (j < F.size("cells"))))
    moved = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.coalesce(strip(F.get("cells", from_(i))), F.lit("")))
    x = x.withColumn("cells", F.when(F.col("child") & (F.col("width") > 0), moved).otherwise(F.col("cells")))
    last = F.coalesce(F.get("cells", F.size("cells") - 1), F.lit(""))
    x = x.select("doc_id", "table_no", "elem_no", F.col("row_no").alias("own_no"), "cells", (F.col("child") & (F.col("row_no") == F.col("first"))).alias("_first"), F.transform("cells", lambda c: c != "").alias("_filled"), strip(last).rlike(r"[.!?:]$").alias("_ends"))
    x = folded(x, ["doc_id", "table_no"], ["elem_no", "own_no"], ["_first", "_filled", "_ends"], Continued(), "row_no long", maps.select("key.doc_id", "table_no", "n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("elem_no", "own_no", "cells"))), lambda r: r["cells"])
    x = x.groupBy("doc_id", "table_no", "row_no").agg(parts.alias("parts"))
    whole = F.transform(F.get("parts", F.lit(0)), lambda _, i: F.array_join(F.filter(F.transform("parts", lambda p: F.get(p, i)), lambda c: c != ""), " "))
    return x.select("doc_id", "table_no", "row_no", F.when(F.size("parts") == 1, F.get("parts", F.lit(0))).otherwise(whole).alias("cells"))
