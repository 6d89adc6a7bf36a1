"""Page layout: words from OCR to lines, pages to clauses."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, repeat
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions.text import roman_repaired, strip
from folio.operators.ranks import at, either, folded, free, grouped, islands, mapped, parted
from folio.runtime import Scratch

#: Short tokens that structure a text and so are never noise.
STRUCTURAL = r"^(\d+[.)]|[a-zđ][.)]|[IVX]+[.)]?|[-•])$"
#: Words that open a chapter, a section and an article.
CHAPTER, SECTION, ARTICLE = "Chương", "Mục", "Điều"
#: Depths of lists that have numbers.
LEVELS = 9


def confident(tokens: DataFrame, least: int = 15) -> DataFrame:
    """OCR tokens that aren't blank nor, with a low confidence, very short noise.
    A confidence that isn't a number counts as 0."""
    conf = F.coalesce(F.col("conf").cast("string").try_cast("int"), F.lit(0))
    text = strip(F.col("text"))
    return tokens.where((text != "") & ((conf >= least) | (F.length(text) > 2) | text.rlike(STRUCTURAL)))


def ocr_lines(tokens: DataFrame, page: str = "page") -> DataFrame:
    """Lines of tokens in their order, with gap: whether a blank line goes before,
    as the block or the paragraph is another than the line before's."""
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "text"))), lambda x: x.text), " ")
    x = tokens.groupBy(page, "block", "par", "line").agg(words.alias("text"))
    by = W.partitionBy(page).orderBy("block", "par", "line")
    new = (F.col("block") != F.lag("block").over(by)) | (F.col("par") != F.lag("par").over(by))
    return x.withColumn("gap", F.coalesce(new, F.lit(False)))


def segments(words: DataFrame, gap: float = 20.0) -> DataFrame:
    """Words (line_id, x0, x1) with segment_no: a new one begins after a gap."""
    by = W.partitionBy("line_id").orderBy("x0", "x1")
    return words.withColumn("segment_no", F.sum(F.coalesce((F.col("x0") - F.lag("x1").over(by) >= gap).cast("int"), F.lit(0))).over(by) + 1)


def on_page(glyphs: DataFrame) -> DataFrame:
    return glyphs.where("top >= 0 and x0 >= 0")


def graphic_noise(x: DataFrame) -> DataFrame:
    """rows (n_words, short, mean, n_cols) with noise: text that is read off a
    drawing, mostly of short words."""
    noise = ((F.col("n_cols") >= 3) & (F.col("short") > 0.35) & (F.col("mean") < 3.8)) | ((F.col("n_cols") == 2) & (F.col("short") > 0.4) & (F.col("mean") < 3.8)) | ((F.col("n_words") <= 3) & (F.col("mean") <= 3.0))
    return x.withColumn("noise", noise)


def image_artifacts(images: DataFrame) -> DataFrame:
    """images (bytes, width, height, std, colour, centre_blank, white, page_share,
    has_text) with artifact: no picture but a trace of the page's making."""
    bad = (F.col("bytes") < 300) | (F.col("width") < 16) | (F.col("height") < 16) | (F.col("std") < 8) | ((F.col("colour") < 12) & (F.col("std") < 14)) | (F.col("centre_blank") > 0.85) | (F.col("white") > 0.88) | ((F.col("page_share") > 0.85) & F.col("has_text"))
    return images.withColumn("artifact", bad)


def line_clusters(glyphs: DataFrame) -> DataFrame:
    """Glyphs (page, glyph_no, x0, top, bottom, ...) with the line they stand on:
    the first one they overlap by a third, or whose middle is near, greedily from
    the top.

    Glyphs of two bands of a page, with nothing between them, are never on one
    line, as then their middles are half of both heights apart at least. So bands
    are found over ranges of rows (ranks.islands), each band is gone through by
    itself, and lines are numbered over the bands before it. In a band glyphs come
    in the order of their middles, and a line that no later one can reach, by the
    band's largest glyph, is given up: a task holds the lines within a glyph's reach.
    A page of up to ranks.LARGE glyphs is gone through whole, which needs no bands'
    numbers.
    """
    return either(parted(glyphs, ["page"], Scratch(glyphs.sparkSession, "lines")), _lines_of_pages, _lines_by_bands)


def _lines_of_pages(glyphs: DataFrame) -> DataFrame:
    # heights that are doubles go along once
    ends = {c: c if glyphs.schema[c].dataType == T.DoubleType() else name for c, name in zip(("top", "bottom"), free(glyphs.columns, "top_of", "bottom_of"), strict=True)}
    x = glyphs.withColumns({name: F.col(c).cast("double") for c, name in ends.items() if c != name})
    mid = (F.col(ends["top"]) + F.col(ends["bottom"])) / 2
    return grouped(x, ["page"], [mid, "x0", "glyph_no"], [*ends.values()], _on_page, "line_no int").select(*map(at, glyphs.columns), "line_no")


def _on_page(glyphs: list[tuple]) -> Iterator[tuple]:
    """A page's glyphs (top, bottom) in order to their lines. In this order bands
    follow each other: one begins below all bottoms before it, above all tops after.
    A glyph as high and at the same height as the one before is on its line."""
    tops, bottoms = np.array(glyphs, float).T
    fresh = np.append(True, (np.diff(tops) != 0) | (np.diff(bottoms) != 0))
    tops, bottoms = tops[fresh], bottoms[fresh]
    new = np.append(True, np.maximum.accumulate(bottoms)[:-1] < np.minimum.accumulate(tops[::-1])[::-1][1:])
    most = np.maximum.reduceat(bottoms - tops, np.flatnonzero(new))[np.cumsum(new) - 1]
    ahead = n = band = 0
    lines = []
    for _, b, _, line in _on_lines(zip(repeat(None), np.cumsum(new).tolist(), ((tops + bottoms) / 2).tolist(), repeat(None), repeat(None), repeat(None), tops.tolist(), bottoms.tolist(), most.tolist(), strict=False)):
        if b != band:
            ahead, n, band = ahead + n, 0, b
        n = max(n, line)
        lines.append(ahead + line)
    return zip(np.array(lines)[np.cumsum(fresh) - 1].tolist(), strict=True)


def _lines_by_bands(glyphs: DataFrame) -> DataFrame:
    scratch = Scratch(glyphs.sparkSession, "lines")
    page = glyphs.schema["page"]
    uid, its = free(glyphs.columns, "uid", "its")
    glyphs = scratch.save(glyphs.withColumn(uid, F.monotonically_increasing_id()), "glyphs")
    x = glyphs.select("page", "glyph_no", F.col(uid).alias("uid"), "x0", F.col("top").cast("double").alias("top"), F.col("bottom").cast("double").alias("bottom"))
    x = scratch.save(islands(x, ["page"], "top", "bottom", name="band").withColumn("mid", (F.col("top") + F.col("bottom")) / 2), "bands")
    most = scratch.save(x.groupBy("page", "band").agg(F.max(F.col("bottom") - F.col("top")).alias("most")).withColumnsRenamed({"page": "p", "band": "b"}), "most")
    x = x.join(most, F.col("page").eqNullSafe(F.col("p")) & (F.col("band") == F.col("b"))).select("page", "band", "mid", "x0", "glyph_no", "uid", "top", "bottom", "most")
    kinds = T.StructType([page, T.StructField("band", T.LongType()), T.StructField("uid", T.LongType()), T.StructField("line", T.LongType())])
    found = scratch.save(mapped(x.repartition("page", "band").sortWithinPartitions("page", "band", "mid", "x0", "glyph_no"), _on_lines, kinds), "found")
    before = W.partitionBy("page").orderBy("band").rowsBetween(W.unboundedPreceding, -1)
    # bands of a page are as many as its lines at most, two numbers each
    ahead = found.groupBy("page", "band").agg(F.max("line").alias("n")).select(F.col("page").alias("p"), F.col("band").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    ahead = scratch.save(ahead, "ahead")
    lines = found.join(ahead, F.col("page").eqNullSafe(F.col("p")) & (F.col("band") == F.col("b"))).select(F.col("uid").alias(its), (F.col("line") + F.col("ahead")).cast("int").alias("line_no"))
    return glyphs.join(lines, F.col(uid) == F.col(its)).drop(uid, its)


def _on_lines(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(page, band, mid, x0, glyph_no, uid, top, bottom, most) in order to (page, band, uid, line from 1)."""
    for (page, band), of in groupby(rows, itemgetter(0, 1)):
        open_: list[list] = []  # line, top, bottom; in the order in which they began
        n = 0
        for _, _, mid, _, _, uid, top, bottom, most in of:
            size = bottom - top
            # a later glyph's top is at least its middle less half of the largest; near middles need more overlap than that
            open_ = [x for x in open_ if x[2] >= mid - most / 2 or mid - (x[1] + x[2]) / 2 <= 0.4 * max(most, x[2] - x[1])]
            for x in open_:
                small, large = min(size, x[2] - x[1]), max(size, x[2] - x[1])
                if min(bottom, x[2]) - max(top, x[1]) >= 0.35 * small or abs(mid - (x[1] + x[2]) / 2) <= 0.4 * large:
                    x[1], x[2] = min(x[1], top), max(x[2], bottom)
                    break
            else:
                n += 1
                x = [n, top, bottom]
                open_.append(x)
            yield page, band, uid, x[0]


def pages_joined(page_lines: DataFrame) -> DataFrame:
    """Lines of pages (doc_id, page_no, line_no, line) without page numbers, with
    joins: whether the line goes on with the sentence that the page before left
    open (it begins in lower case, or that one ends in a comma)."""
    s = strip(F.col("line"))
    kept = page_lines.where((s != "") & ~s.rlike(r"^[-–]?\s*\d{1,4}\s*[-–]?$"))
    by = W.partitionBy("doc_id").orderBy("page_no", "line_no")
    before, page = F.lag(s).over(by), F.lag("page_no").over(by)
    open_ = ~before.rlike(r"[.;:!?]$") & (before.rlike(r",$") | s.rlike(r"^\p{Ll}"))
    return kept.withColumn("joins", F.coalesce((page != F.col("page_no")) & open_, F.lit(False)))


def legal_lines(page_lines: DataFrame) -> DataFrame:
    """Lines of legal texts (doc_id, seq, line) with kind and Markdown: chapters,
    sections and articles are headings, numbered lines clauses, lettered ones
    points; a chapter's Roman number is repaired and the next line is its title."""
    s = strip(F.col("line"))
    by = W.partitionBy("doc_id").orderBy("seq")
    kind = F.when(s.rlike(rf"^(?i){CHAPTER}\s+\S+"), "chapter").when(s.rlike(rf"^(?i){SECTION}\s+\d+"), "section").when(s.rlike(rf"^(?i){ARTICLE}\s+\d+\s*[.:]"), "article").when(s.rlike(r"^\d+\s*[.)]\s"), "clause").when(s.rlike(r"^[a-zđ]\s*[.)]\s"), "point").otherwise("text")
    x = page_lines.withColumns({"line": s, "kind": kind})
    title = (F.lag("kind").over(by) == "chapter") & (F.col("kind") == "text")
    x = x.withColumns({"kind": F.when(F.coalesce(title, F.lit(False)), "title").otherwise(F.col("kind")), "after": F.lead("line").over(by), "next_kind": F.lead("kind").over(by)})
    number = roman_repaired(F.regexp_extract("line", rf"^(?i){CHAPTER}\s+(\S+)", 1))
    name = F.concat(F.lit(f"# {CHAPTER} "), number, F.when(F.col("next_kind") == "text", F.concat(F.lit(": "), F.col("after"))).otherwise(""))
    md = F.when(F.col("kind") == "chapter", name).when(F.col("kind") == "section", F.concat(F.lit("## "), "line")).when(F.col("kind") == "article", F.concat(F.lit("### "), "line")).when(F.col("kind") == "point", F.concat(F.lit("- "), "line")).otherwise(F.col("line"))
    return x.where("kind <> 'title'").select("doc_id", "seq", "kind", md.alias("markdown"))


class Rising:
    """Numbers that rise from the second on: a missing one, or one that doesn't rise,
    is one more than the last.

    From 2 on a row makes max(last + 1, number) of the last one, so a stretch of
    rows makes max(last + n, least); a stretch's first number is told apart from
    the missing ones before it, as a last one below 2 takes any number.
    """

    begin = 0

    @staticmethod
    def step(last: int, number: int | None) -> int:
        return last + 1 if number is None or last >= 2 and number <= last else number

    def summary(self, rows: Iterator[tuple]) -> tuple[int, int | None, int, int, int]:
        missing, first, fresh, n, least = 0, None, 0, 0, 0
        for (number,) in rows:
            if first is None and number is None:
                missing += 1
            elif first is None:
                first = fresh = number
            else:
                fresh, n, least = self.step(fresh, number), n + 1, max(least + 1, number if number is not None else 0)
        return missing, first, fresh, n, least

    def after(self, last: int, summary: tuple) -> int:
        missing, first, fresh, n, least = summary
        last += missing
        if first is None:
            return last
        return max(last + 1 + n, least) if last >= 2 and first <= last else fresh

    def outputs(self, last: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        for (number,) in rows:
            last = self.step(last, number)
            yield (last,)


def clause_numbers(clauses: DataFrame) -> DataFrame:
    """Clauses (doc_id, article, seq, number) with repaired numbers: from the second
    on they rise, so one that doesn't, or that wasn't read (null), is one more than
    the last. Each depends on the one before as repaired; an article of any length
    is gone through in ranges side by side (ranks.folded)."""
    x = clauses.select("doc_id", "article", "seq", F.col("number").cast("long").alias("number"))
    return folded(x, ["doc_id", "article"], ["seq"], ["number"], Rising(), "repaired long").select("doc_id", "article", "seq", F.col("repaired").cast("int").alias("repaired"))


def item_numbers(items: DataFrame) -> DataFrame:
    """Numbered items (doc_id, seq, level, numbered) with their number: it starts
    again after an item of the level that has none, or of a higher level. Levels
    beyond LEVELS or below 1 and null ones have no numbers."""
    by = W.partitionBy("doc_id").orderBy("seq")
    levels = [F.sum(F.when((F.col("level") < k) | ((F.col("level") == k) & ~F.col("numbered")), 1).otherwise(0)).over(by) for k in range(1, LEVELS + 1)]
    x = items.withColumn("_island", F.get(F.array(*levels), F.col("level") - 1))
    return x.withColumn("number", F.when(F.col("numbered") & F.col("level").between(1, LEVELS), F.row_number().over(W.partitionBy("doc_id", "level", "numbered", "_island").orderBy("seq")))).drop("_island")
