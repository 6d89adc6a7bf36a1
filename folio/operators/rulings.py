"""Tables on pages by the strokes that rule them."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.operators.ranks import either, islands, mapped, parted
from folio.runtime import Scratch

#: Units of a page in a bin of crossings.
BIN = 64.0


def edges(strokes: DataFrame, scratch: Scratch, near: float = 3.0, least: float = 3.0) -> DataFrame:
    """page, flat, at, lo, hi, band, edge: the lines that strokes (page, x0, top, x1,
    bottom) make, flat ones (from lo to hi at the height at) and upright ones, with
    the band of the page they lie in and a number.

    A stroke over ``near`` in both directions is a box with four sides. Lines of one
    direction that follow each other within ``near`` are put on their mean, and on
    one line stretches with a gap of up to ``near`` are joined; what is shorter
    than ``least`` then is left out. Bands are stretches of the page's height that
    nothing reaches over, so no table lies in two of them. All three are islands; a
    page of up to ranks.LARGE lines goes through them after one shuffle, larger
    ones over ranges of rows."""
    s = strokes.where("page is not null and x0 is not null and x1 is not null and top is not null and bottom is not null")
    x0, x1, top, bottom = F.least("x0", "x1"), F.greatest("x0", "x1"), F.least("top", "bottom"), F.greatest("top", "bottom")
    line = lambda flat, at, lo, hi: F.struct(F.lit(flat).alias("flat"), at.cast("double").alias("at"), lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))
    box = F.array(line(True, top, x0, x1), line(True, bottom, x0, x1), line(False, x0, top, bottom), line(False, x1, top, bottom))
    thin = F.when(bottom - top <= x1 - x0, F.array(line(True, top, x0, x1))).otherwise(F.array(line(False, x0, top, bottom)))
    of_box = (x1 - x0 > near) & (bottom - top > near)
    lines = lambda x: x.select("page", F.explode(F.when(of_box, box).otherwise(thin)).alias("e")).select("page", "e.*")
    parts = parted(s.select("page", "x0", "top", "x1", "bottom"), ["page"], scratch, s.select("page", F.when(of_box, 4).otherwise(1).alias("n")))
    x = either(parts, lambda x: _edges_of_pages(lines(x.repartition("page")), near, least), lambda x: _edges_by_ranges(lines(x), scratch, near, least))
    return scratch.save(x.select("page", "flat", "at", "lo", "hi", "band").withColumn("edge", F.monotonically_increasing_id()), "edges")


def _ends(x: DataFrame) -> DataFrame:
    """Lines with their extent over the page's height."""
    return x.withColumns({"top": F.when(F.col("flat"), F.col("at")).otherwise(F.col("lo")), "bottom": F.when(F.col("flat"), F.col("at")).otherwise(F.col("hi"))})


def _island(by: list[str], start: str, end: str, near: float, x: DataFrame, name: str) -> DataFrame:
    """ranks.islands() of small groups that are where they are to be."""
    own = W.partitionBy(*by).orderBy(start, end)
    new = F.coalesce(F.col(start) > F.max(end).over(own.rowsBetween(W.unboundedPreceding, -1)) + near, F.lit(True)).cast("long")
    return x.withColumn("_new", new).withColumn(name, F.sum("_new").over(own.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def _edges_of_pages(x: DataFrame, near: float, least: float) -> DataFrame:
    """A page's lines are in one partition and stay there."""
    x = _island(["page", "flat"], "at", "at", near, x, "cluster")
    # added up by height, as the last digits of a mean depend on the order
    of = W.partitionBy("page", "flat", "cluster").orderBy("at").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    x = x.withColumn("mean", F.avg("at").over(of))
    x = _island(["page", "flat", "cluster"], "lo", "hi", near, x, "stretch")
    x = x.groupBy("page", "flat", "cluster", "stretch").agg(F.first("mean").alias("at"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where(F.col("hi") - F.col("lo") >= least)
    return _island(["page"], "top", "bottom", near, _ends(x), "band").select("page", "flat", "at", "lo", "hi", "band")


def _edges_by_ranges(x: DataFrame, scratch: Scratch, near: float, least: float) -> DataFrame:
    x = scratch.save(islands(x, ["page", "flat"], "at", "at", near, "cluster"), "clusters")
    mean = scratch.save(x.groupBy("page", "flat", "cluster").agg(F.avg("at").alias("mean")), "means")
    x = x.join(mean, ["page", "flat", "cluster"]).select("page", "flat", "cluster", F.col("mean").alias("at"), "lo", "hi")
    x = islands(x, ["page", "flat", "cluster"], "lo", "hi", near, "stretch")
    x = x.groupBy("page", "flat", "cluster", "stretch").agg(F.first("at").alias("at"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where(F.col("hi") - F.col("lo") >= least)
    x = scratch.save(x.select("page", "flat", "at", "lo", "hi"), "stretches")
    return islands(_ends(x), ["page"], "top", "bottom", near, "band").select("page", "flat", "at", "lo", "hi", "band")


def crossings(lines: DataFrame, near: float = 3.0) -> DataFrame:
    """page, band, x, y, flat_edge and upright_edge where two edges() meet or miss
    each other by ``near`` at most.

    They meet in the bin that the crossing lies in, once: a flat line is in the
    bins along it, an upright one as well."""
    along = F.explode(F.sequence(F.floor((F.col("lo") - near) / BIN), F.floor((F.col("hi") + near) / BIN)))
    bins = lines.withColumns({"along": along, "across": F.floor(F.col("at") / BIN)})
    h = bins.where("flat").select("page", "band", F.col("along").alias("bx"), F.col("across").alias("by"), F.col("at").alias("y"), F.col("lo").alias("x0"), F.col("hi").alias("x1"), F.col("edge").alias("flat_edge"))
    v = bins.where("not flat").select(F.col("page").alias("_p"), F.col("across").alias("_bx"), F.col("along").alias("_by"), F.col("at").alias("x"), F.col("lo").alias("y0"), F.col("hi").alias("y1"), F.col("edge").alias("upright_edge"))
    met = (F.col("page") == F.col("_p")) & (F.col("bx") == F.col("_bx")) & (F.col("by") == F.col("_by"))
    close = (F.col("y0") <= F.col("y") + near) & (F.col("y1") >= F.col("y") - near) & (F.col("x") >= F.col("x0") - near) & (F.col("x") <= F.col("x1") + near)
    return h.join(v, met & close).select("page", "band", "x", "y", "flat_edge", "upright_edge")


def cells_of(points: dict[tuple[float, float], tuple[set, set]]) -> list[tuple[float, float, float, float]]:
    """The smallest cell below and right of each crossing whose corners lie on
    common edges, the nearest lower corner first, then the nearest to the right.
    points: (x, y) to its flat and its upright edges."""
    columns: dict[float, list[float]] = {}
    rows: dict[float, list[float]] = {}
    for x, y in sorted(points):
        columns.setdefault(x, []).append(y)
        rows.setdefault(y, []).append(x)
    out = []
    for x, y in sorted(points):
        flat, upright = points[x, y]
        rights = [r for r in rows[y][bisect_right(rows[y], x) :] if points[r, y][0] & flat]
        for low in columns[x][bisect_right(columns[x], y) :] if rights else ():
            below = points[x, low]
            if not below[1] & upright:
                continue
            far = next((r for r in rights if (q := points.get((r, low))) and q[1] & points[r, y][1] and q[0] & below[0]), None)
            if far is not None:
                out.append((x, y, far, low))
                break
    return out


def tables_of(cells: list[tuple[float, float, float, float]]) -> list[list[tuple[float, float, float, float]]]:
    """Cells that share corners, tables of two cells or more, from the top and left."""
    parent = list(range(len(cells)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    corner: dict[tuple[float, float], int] = {}
    for k, (x0, y0, x1, y1) in enumerate(cells):
        for c in ((x0, y0), (x1, y0), (x0, y1), (x1, y1)):
            parent[root(k)] = root(corner.setdefault(c, k))
    found: dict[int, list] = {}
    for k, c in enumerate(cells):
        found.setdefault(root(k), []).append(c)
    return sorted((t for t in found.values() if len(t) > 1), key=lambda t: min((c[1], c[0]) for c in t))


def _cells(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(page, band, x, y, flat_edge, upright_edge) in order to (page, band, table, row, column, x0, top, x1, bottom)."""
    for (page, band), of in groupby(rows, itemgetter(0, 1)):
        points: dict[tuple[float, float], tuple[set, set]] = {}
        for _, _, x, y, h, v in of:
            at = points.setdefault((x, y), (set(), set()))
            at[0].add(h)
            at[1].add(v)
        for n, t in enumerate(tables_of(cells_of(points)), 1):
            tops = {y: i for i, y in enumerate(sorted({c[1] for c in t}), 1)}
            lefts = {x: i for i, x in enumerate(sorted({c[0] for c in t}), 1)}
            for x0, y0, x1, y1 in sorted(t, key=lambda c: (c[1], c[0])):
                yield page, band, n, tops[y0], lefts[x0], x0, y0, x1, y1


def ruled_tables(strokes: DataFrame, near: float = 3.0, least: float = 3.0) -> DataFrame:
    """page, table_no, row_no, col_no, x0, top, x1, bottom of the cells that strokes
    (page, x0, top, x1, bottom) rule; a row or column is where cells begin.

    Lines are snapped, joined and crossed as rows. Crossings of one band of a page
    (as much as stands there side by side) are put together to cells by one task;
    a page of many tables below each other is spread. Strokes without a page or
    with a null extent are left out; repeated ones change nothing; a page without
    two neighbouring cells has no rows.
    """
    scratch = Scratch(strokes.sparkSession, "rulings")
    met = crossings(edges(strokes, scratch, near, least), near)
    kinds = T.StructType([strokes.schema["page"], *(T.StructField(c, k) for c, k in [("band", T.LongType()), *((n, T.IntegerType()) for n in ("local", "row_no", "col_no")), *((n, T.DoubleType()) for n in ("x0", "top", "x1", "bottom"))])])
    x = scratch.save(mapped(met.repartition("page", "band").sortWithinPartitions("page", "band"), _cells, kinds), "cells")
    # a row for each table
    numbers = x.select("page", "band", "local").distinct().withColumn("table_no", F.row_number().over(W.partitionBy("page").orderBy("band", "local")))
    numbers = scratch.save(numbers, "numbers")
    return x.join(numbers, ["page", "band", "local"]).select("page", "table_no", "row_no", "col_no", "x0", "top", "x1", "bottom")


def cell_texts(cells: DataFrame, words: DataFrame) -> DataFrame:
    """ruled_tables() with the words (page, word_no, x0, x1, top, bottom, text) whose
    middles lie in each cell, by height, then from the left; empty where there are
    none. Words meet the cells of their own bin only."""
    scratch = Scratch(cells.sparkSession, "cells")
    cells = scratch.save(cells, "cells")
    mid = words.select(F.col("page").alias("_p"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("top") + F.col("bottom")) / 2).alias("y"), F.col("x0").alias("left"), "word_no", "text").where("text is not null")
    mid = mid.withColumns({"_bx": F.floor(F.col("x") / BIN), "_by": F.floor(F.col("y") / BIN)})
    over = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / BIN), F.floor(F.col(b) / BIN)))
    binned = cells.withColumn("bx", over("x0", "x1")).withColumn("by", over("top", "bottom"))
    met = (F.col("page") == F.col("_p")) & (F.col("bx") == F.col("_bx")) & (F.col("by") == F.col("_by"))
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("top")) & (F.col("y") < F.col("bottom"))
    at = ["page", "table_no", "row_no", "col_no"]
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y", "left", "word_no", "text"))), lambda w: w["text"]), " ")
    found = binned.join(mid, met & inside).groupBy(*at).agg(text.alias("text"))
    return cells.join(found, at, "left").withColumn("text", F.coalesce("text", F.lit("")))
