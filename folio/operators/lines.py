"""Documents as lines, and what follows from a line's neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from folio.functions.text import is_separator, strip


def by_line() -> WindowSpec:
    return W.partitionBy("doc_id").orderBy("line_no")


def before() -> WindowSpec:
    return by_line().rowsBetween(W.unboundedPreceding, -1)


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line_no from 0, line. A null text has no line, an empty one one."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))


def stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines, words, characters and pipe tables of each document. A table is a run
    of lines with a pipe, two of which at least aren't separators; runs are found
    in the text itself, so nothing is shuffled."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    runs = F.regexp_extract_all(text, F.lit(r"(?m)(?:^[^\n]*\|[^\n]*(?:\n|$))+"), 0)
    rows = lambda run: F.size(F.filter(F.split(run, "\n"), lambda x: x.contains("|") & ~is_separator(x)))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.size(F.split(text, "\n")).alias("n_lines"),
        F.regexp_count(text, F.lit(r"[^\s\x0b\x{1c}-\x{1f}\x{85}\p{Z}]+")).alias("n_words"),
        F.length(text).alias("n_chars"),
        F.size(F.filter(runs, lambda r: rows(r) >= 2)).alias("n_tables"),
    )


def fenced(rows: DataFrame) -> DataFrame:
    """rows with in_code: whether an odd number of fences stands above the line."""
    fence = F.col("line").rlike(r"^\s*(```|~~~)")
    return rows.withColumns({"is_fence": fence, "in_code": F.coalesce(F.sum(fence.cast("int")).over(before()), F.lit(0)) % 2 == 1})


def classified(rows: DataFrame) -> DataFrame:
    """rows (with in_code and is_fence) with the block kind of each line and the
    level of headings and list items. The first rule that fits counts."""
    s = strip(F.col("line"))
    kind = (
        F.when(F.col("is_fence"), "fence")
        .when(F.col("in_code"), "code")
        .when(s == "", "blank")
        .when(s.rlike(r"^#{1,6}\s+\S"), "heading")
        .when(s.rlike(r"^(-{3,}|\*{3,}|_{3,})$"), "rule")
        .when(s.contains("|") & is_separator(s), "separator")
        .when(s.contains("|"), "table")
        .when(s.rlike(r"^[-*+•] "), "bullet")
        .when(s.rlike(r"^\d+[.)] "), "number")
        .when(s.rlike(r"^>"), "quote")
        .otherwise("paragraph")
    )
    indent = F.length(F.regexp_extract("line", r"^( *)", 1))
    level = F.when(kind == "heading", F.length(F.regexp_extract(s, r"^(#+)", 1))).when(kind.isin("bullet", "number"), F.floor(indent / 2) + 1)
    return rows.withColumns({"kind": kind, "level": level.cast("int")})


def list_breaks(rows: DataFrame) -> DataFrame:
    """rows with blank_before: a bold or heading line after a list item, which
    would be read as part of the item without a blank line."""
    s = strip(F.col("line"))
    item, head = s.rlike(r"^([-*] |\d+\.\s)"), s.rlike(r"^(\*\*|#)")
    event = F.when(item, "item").when(head, "head")
    return rows.withColumn("blank_before", head & ~item & (F.last(event, ignorenulls=True).over(before()).eqNullSafe("item")))


def offsets(rows: DataFrame) -> DataFrame:
    """rows with the position of each line's first character in the text."""
    return rows.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(before()), F.lit(0)).cast("long"))


def contents(rows: DataFrame) -> DataFrame:
    """Headings (kind and level of classified) with levels rebased so that the
    first one is of level 1."""
    head = rows.where("kind = 'heading'")
    first = F.first("level").over(by_line().rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return head.select("doc_id", "line_no", "level", F.greatest(F.lit(1), F.col("level") - (first - 1)).alias("toc_level"), F.regexp_replace(strip(F.col("line")), r"^#+\s+", "").alias("title"))


def bullets_repaired(text: Column) -> Column:
    """Bullet signs at the start of lines become "- "."""
    return F.regexp_replace(text, r"(?m)^([ \t]*)[•·⁃▪][ \t]*", "$1- ")


def joined(rows: DataFrame, line: str = "line") -> DataFrame:
    """The text of each document again."""
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", line))), lambda x: x[line]), "\n").alias("text"))


def slides(rows: DataFrame) -> DataFrame:
    """rows (with in_code and is_fence) with slide_no: a line of dashes between blank
    lines divides slides. A document without one is divided at headings of the first
    three levels outside code, but for notes, where two lines at least that aren't
    blank stand since the last cut; that depends on the cut before, so those
    documents' lines are gone over in order, and one number is held."""
    near = lambda k: F.coalesce(F.lag("line", k).over(by_line()), F.lit("")) == ""
    dash = (F.col("line") == "---") & near(1) & near(-1) & ~F.col("in_code")
    s = strip(F.col("line"))
    head = s.rlike(r"^#{1,3}\s+\S") & ~s.rlike(r"(?i)^#{1,3}\s*notes:") & ~F.col("in_code") & ~F.col("is_fence")
    x = rows.withColumns({"_dash": dash, "_any": F.max(dash).over(W.partitionBy("doc_id")), "_head": head, "_blank": s == ""})
    divided = x.where("_any").withColumn("slide_no", F.sum(F.col("_dash").cast("int")).over(by_line()) + 1).where("not _dash")

    def number(state: list, doc: object, is_head: bool, blank: bool) -> int:
        if not state or doc != state[0]:
            state[:] = [doc, 1, 0]
        elif is_head and state[2] >= 2:
            state[1:] = [state[1] + 1, 0]
        state[2] += not blank
        return state[1]

    dealt = x.where("not _any").repartition("doc_id").sortWithinPartitions("doc_id", "line_no")
    cut = carried(dealt, rows.columns, ["doc_id", "_head", "_blank"], number, "slide_no", T.LongType())
    return divided.select(*rows.columns, "slide_no").unionByName(cut)


def carried(dealt: DataFrame, keep: list[str], given: list[str], step: Callable[..., int], name: str, kind: T.DataType) -> DataFrame:
    """Rows in order with a number more: what step makes of its own state, an empty
    list at first, and the given columns. The kept columns go through as they are, so
    nothing has to meet its row again: how many rows come of a text is no table's
    size to Spark, and such a join would be broadcast by way of the driver."""
    schema = T.StructType([*(dealt.schema[c] for c in keep), T.StructField(name, kind)])
    wanted = list(dict.fromkeys([*keep, *given]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list = []
        for b in batches:
            out = [step(state, *row) for row in zip(*(b.column(wanted.index(c)).to_pylist() for c in given), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(wanted.index(c)) for c in keep), pa.array(out, to_arrow_type(kind))], [*keep, name])

    return dealt.select(*wanted).mapInArrow(run, schema)
