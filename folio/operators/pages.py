"""Text of a page in reading order, from its glyphs."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions.text import strip
from folio.operators.layout import line_clusters
from folio.operators.ranks import folded
from folio.operators.workspace import header_first
from folio.runtime import Scratch

#: What ends a sentence, what leaves one open, marks of bullets.
ENDS, OPEN, MARKS = r"(?:[.!?…;~”\"’»)\]}])$", r"[,–—/&、，-]\s*$", "[•·⁃▪]"
#: The space between columns, the height of a page's head, and where a line counts as wide or as left.
GUTTER, HEAD, WIDE, LEFT = 20.0, 60.0, (300.0, 250.0, 550.0), 420.0
#: Words that no card's heading begins or ends with.
LOOSE = ["những", "các", "về", "của", "và", "khi", "cho", "để", "trong", "với", "là", "tại", "có", "ở", "được", "ng", "cô", "thời", "nhỏ", "năng", "đấu", "trợ", "à"]


def words(text: Column, most: int = -1) -> Column:
    """The words of a text; from the place ``most`` on the rest is one."""
    return F.filter(F.split(text, r"(?U)\s+", most), lambda w: w != "")


def capitals(text: Column) -> Column:
    """Whether there are letters, all in capitals."""
    return (F.upper(text) == text) & (F.lower(text) != text)


class Wrapped:
    """Lines that go on with the one before, as it is after all joins so far.

    A row is (level, words, lower, ends, opens, bullet, bold, head): a heading's
    level or 0, the number of words, whether the line begins in lower case, ends a
    sentence, leaves one open, begins as a bullet or in bold, and heads a section.
    A state is what a joined line is like: level, up to five words, ends, opens,
    bullet, bold. A stretch of rows is summed up by what it makes of each state;
    the states flow together within a few lines.
    """

    begin = (None, 0, 0)
    STATES = [None, *((v, w, e, o, b, s) for v in range(4) for w in range(6) for e in (False, True) for o in (False, True) for b in (False, True) for s in (False, True))]

    @staticmethod
    def step(state: tuple | None, row: tuple) -> tuple[tuple, bool]:
        level, n, lower, ends, opens, bullet, bold, _ = row
        own = (level, min(n, 5), ends, opens, bullet, bold)
        if state is None:
            return own, True
        v, w, e, o, b, s = state
        if lower:
            goes_on = True
        elif v > 0 and level > 0 and v == level and not e:
            goes_on = True
        else:
            goes_on = v == 0 and level == 0 and not (b or bullet or s) and (o or w >= 5 and not e)
        return ((v, min(5, w + n), ends, opens, b, s), False) if goes_on else (own, True)

    def summary(self, rows: Iterator[tuple]) -> tuple[list, int]:
        # each state's place among the distinct ones, those with the lines they have begun
        of, now, heads = list(range(len(self.STATES))), [(s, 0) for s in self.STATES], 0
        for row in rows:
            heads += row[-1]
            new = [(t, n + starts) for (s, n) in now for t, starts in [self.step(s, row)]]
            if len(new) > 1:
                places: dict = {}
                to = [places.setdefault(x, len(places)) for x in new]
                if len(places) < len(new):
                    of, new = [to[k] for k in of], list(places)
            now = new
        return [now[k] for k in of], heads

    def after(self, state: tuple, summary: tuple) -> tuple:
        to, n = summary[0][self.STATES.index(state[0])]
        return to, state[1] + n, state[2] + summary[1]

    def outputs(self, state: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        line, n, heads = state
        for row in rows:
            line, starts = self.step(line, row)
            n, heads = n + starts, heads + row[-1]
            yield n, heads


def wrapped(items: DataFrame, by: list[str], order: list[str | Column], sizes: DataFrame | None = None) -> DataFrame:
    """Lines (text, level; blank ones left out) with item_no, the joined line they
    belong to, and section_no, the headings so far. A group of lines may have any
    size (ranks.folded). sizes: by and n, at least the group's lines, where that is
    less to read."""
    s, last = strip(F.col("text")), F.right(F.col("_s"), F.lit(1))
    # $ also stands before these signs
    last = F.when(last.isin("\u0085", "\u2028", "\u2029"), F.col("_s")).otherwise(last)
    n = F.size(words(F.col("_s"), 8))  # more than six are as good as six
    made = {
        "_words": n,
        "_lower": F.col("text").rlike(r"^\p{Ll}"),
        "_ends": last.rlike(ENDS),
        "_opens": last.rlike(OPEN),
        "_bullet": F.col("text").startswith("- "),
        "_bold": F.col("text").startswith("**"),
        "_head": (F.col("level") > 0) | ((n <= 4) & capitals(F.col("text"))),
    }
    x = items.withColumn("_s", s).where(F.col("_s") != "").withColumns(made).drop("_s")
    # blank lines count, too: whether a line is one takes longer to see
    sizes = items.select(*by, F.lit(1).alias("n")) if sizes is None else sizes
    return folded(x, by, order, ["level", *made], Wrapped(), "item_no long, section_no long", sizes).drop(*made)


def joined_lines(items: DataFrame, by: list[str], order: list[str], sizes: DataFrame | None = None) -> DataFrame:
    """Lines (text, level) to by, item_no, level and text of whole paragraphs and
    headings. sizes: as for wrapped()."""
    x = wrapped(items, by, order, sizes)
    body = F.sort_array(F.collect_list(F.struct(*order, "text")))
    return x.groupBy(*by, "item_no").agg(F.array_join(F.transform(body, lambda r: r["text"]), " ").alias("text"), F.min_by("level", F.struct(*order)).alias("level"))


def stretches(glyphs: DataFrame) -> DataFrame:
    """Glyphs (page, line_no, x0, x1, top, mid, glyph_no, text, size, bold, italic) to
    stretches of lines (page, line_no, segment_no, top, x0, x1), cut where a gutter
    is, with their text and mean size: runs of one style are marked, a gap over a
    quarter of a glyph is a space. A line's glyphs are sorted once."""
    line = W.partitionBy("page", "line_no").orderBy("x0", "mid", "glyph_no")
    style = F.struct(F.col("bold").alias("b"), F.col("italic").alias("i"))
    before = lambda c: F.lag(c).over(line)
    told = lambda c: F.coalesce(c, F.lit(False))
    spaced = (F.col("x0") - before("x1") > (F.col("x1") - F.col("x0")) * 0.25) & ~before("text").endswith(" ") & (F.col("text") != " ")
    x = glyphs.withColumns({"_cut": told(F.col("x0") - before("x1") >= GUTTER), "_new": told(style != before(style)), "_space": told(spaced)})
    so_far = lambda c: F.sum(c.cast("int")).over(line.rowsBetween(W.unboundedPreceding, 0))
    x = x.withColumns({"segment_no": so_far(F.col("_cut")) + 1, "_run": so_far(F.col("_new") & ~F.col("_cut")), "_text": F.when(F.col("_space") & ~F.col("_new") & ~F.col("_cut"), F.concat(F.lit(" "), "text")).otherwise(F.col("text"))})
    by, extent = ["page", "line_no", "segment_no"], (F.min("top").alias("top"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "mid", "glyph_no", "_text"))), lambda r: r["_text"]), "")
    runs = x.groupBy(*by, "_run").agg(whole.alias("_t"), F.first("bold").alias("b"), F.first("italic").alias("i"), F.sum("size").alias("_size"), F.count("*").alias("_n"), *extent)
    inner, mark = strip(F.col("_t")), F.when(F.col("b") & F.col("i"), "***").when(F.col("b"), "**").when(F.col("i"), "*").otherwise("")
    marked = F.concat(F.regexp_extract("_t", r"(?U)^(\s*)", 1), mark, inner, mark, F.regexp_extract("_t", r"(?U)(\s*)$", 1))
    runs = runs.withColumn("_t", F.when((mark == "") | (inner == ""), F.col("_t")).otherwise(marked))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_run", "_t"))), lambda r: r["_t"]), "")
    return runs.groupBy(*by).agg(strip(text).alias("text"), (F.sum("_size") / F.sum("_n")).alias("_size"), *extent)


def formatted(x: DataFrame) -> DataFrame:
    """stretches() with text and level: marks become bullets, and large or capital
    lines headings. kept is false for those that hold no text but a mark."""
    x = x.withColumn("kept", ~F.col("text").isin("", "-", "•", "·", "⁃", "▪"))
    t = F.col("text")
    for _ in range(3):
        t = F.regexp_replace(t, r"\*\*(.*?)\*\*([^\s*]{1,3})\*\*(.*?)\*\*", "**$1$2$3**")
        t = F.regexp_replace(t, r"(?U)\*\*(.*?)\*\*\s*\*\*(.*?)\*\*", "**$1 $2**")
    x = x.withColumn("text", F.when(F.col("text").contains("**"), t).otherwise(F.col("text")))
    bullet = F.col("text").rlike(rf"(?U)^({MARKS}|[-*]\s)")
    listed = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", rf"(?U)^{MARKS}\s*", "- "), r"(?U)^\*\s+", "- "), rf"(?U)\s+{MARKS}\s+", "\n- ")
    x = x.withColumn("text", F.when(bullet, listed).otherwise(F.col("text"))).withColumn("_bullet", bullet | F.col("text").startswith("- "))
    n, number = F.size(words(F.col("text"))), F.col("text").rlike(r"(?iU)^\s*(\*{0,2}\d{1,3}\*{0,2}|p\.\s*\d+)\s*$")
    head = ~F.col("_bullet") & ~number & (F.col("text").rlike(r"^\p{Lu}") | capitals(F.col("text")))
    level = F.when((F.col("_size") >= 22) & head & (n <= 7), 1).when((F.col("_size") >= 13.5) & (F.col("_size") < 17) & head & capitals(F.col("text")) & (n <= 5), 3).otherwise(0)
    x = x.withColumn("level", level).withColumn("text", F.when(F.col("level") > 0, F.regexp_replace("text", r"\*{2,3}", "")).otherwise(F.col("text")))
    return x.drop("_bullet", "_size")


def streams(glyphs: DataFrame, scratch: Scratch, width: float) -> tuple[DataFrame, DataFrame]:
    """(formatted() stretches with line_top and stream, pages with n_cols and columns).

    A line is cut where a gutter is. Lines with as many parts as the page has
    columns, three or more, go to these; other parts by their middle, but a line of
    one part in the page's head or over its width comes first (stream 0). On pages
    of fewer columns first parts and lines on the left are stream 1, the rest 2.
    Glyphs are gone through once; all that follows is of stretches.
    """
    x = line_clusters(glyphs).withColumn("mid", (F.col("top") + F.col("bottom")) / 2)
    of_line = W.partitionBy("page", "line_no")
    parts = formatted(stretches(x)).withColumns({"line_top": F.min("top").over(of_line), "n": F.max("segment_no").over(of_line)})
    parts = scratch.save(parts.drop("top"), "parts")
    pages = parts.groupBy("page").agg(F.max("n").alias("n_cols"), F.min("line_top").alias("page_top"))
    parts = parts.join(pages, "page")
    long = (F.col("x1") - F.col("x0") > WIDE[0]) & (F.col("x0") < WIDE[1]) & (F.col("x1") > WIDE[2])
    first = (F.col("n") == 1) & ((F.col("line_top") < F.col("page_top") + HEAD) | long)
    mid = (F.col("x0") + F.col("x1")) / 2
    by_place = F.least(F.col("n_cols") - 1, F.greatest(F.lit(0), (mid / width * F.col("n_cols")).cast("int"))) + 1
    many = F.when(first, 0).when(F.col("n") == F.col("n_cols"), F.col("segment_no")).otherwise(by_place)
    few = F.when(F.col("n") > 1, F.least("segment_no", F.lit(2))).when(first, 0).when(mid < LEFT, 1).otherwise(2)
    stream = F.when(F.col("n_cols") >= 3, many).otherwise(few).cast("int").alias("stream")
    parts = scratch.save(parts.select("page", "line_no", "segment_no", "line_top", "n_cols", stream, "text", "level", "kept"), "streams")
    sides = parts.groupBy("page").agg(F.max("n_cols").alias("n_cols"), F.max((F.col("stream") == 1).cast("int")).alias("l"), F.max((F.col("stream") == 2).cast("int")).alias("r"))
    pages = scratch.save(sides.select("page", "n_cols", ((F.col("n_cols") > 1) | ((F.col("l") == 1) & (F.col("r") == 1))).alias("columns")), "layout")
    return parts.drop("n_cols"), pages


def headed(text: Column, level: Column) -> Column:
    return F.when(level > 0, F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text)).otherwise(text)


def comparison(items: DataFrame) -> DataFrame:
    """page and comparison: the Markdown table of pages whose two columns have as
    many sections, each with a short heading, and text below the first one. items:
    page, stream (1 or 2), seq (in order), text, level, section_no."""
    opens = lambda x: ~x.startswith("- ") & (F.size(words(x)) <= 5)
    is_head = (F.col("level") > 0) | (capitals(F.col("text")) & (F.size(words(F.col("text"))) <= 4))
    first = items.groupBy("page", "stream").agg(F.min_by("text", "seq").alias("first")).groupBy("page").agg(F.min(opens(F.col("first"))).alias("ok"), F.count("*").alias("sides"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~is_head, F.struct("seq", "text")))), lambda r: r["text"]), "<br><br>")
    sections = items.groupBy("page", "stream", "section_no").agg(F.coalesce(F.max(F.when(is_head, F.col("text"))), F.lit("")).alias("h"), body.alias("b"))
    lists = sections.groupBy("page").agg(*(F.sort_array(F.collect_list(F.when(F.col("stream") == k, F.struct("section_no", "h", "b")))).alias(f"s{k}") for k in (1, 2)))
    rows = F.zip_with("s1", "s2", lambda a, b: F.struct(a["h"].alias("hl"), b["h"].alias("hr"), a["b"].alias("bl"), b["b"].alias("br")))
    x = lists.join(first, "page").where((F.col("sides") == 2) & F.col("ok") & (F.size("s1") == F.size("s2"))).withColumn("rows", rows)
    top = F.get("rows", F.lit(0))
    x = x.where((top["hl"] != "") & (top["hr"] != "") & (top["bl"] != "") & (top["br"] != ""))
    row = lambda a, b, m="": F.concat(F.lit(f"| {m}"), a, F.lit(f"{m} | {m}"), b, F.lit(f"{m} |"))
    more = F.flatten(F.transform(F.slice("rows", F.lit(2), F.greatest(F.size("rows") - 1, F.lit(0))), lambda r: F.concat(F.when((r["hl"] != "") | (r["hr"] != ""), F.array(row(r["hl"], r["hr"], "**"))).otherwise(F.array().cast("array<string>")), F.when((r["bl"] != "") | (r["br"] != ""), F.array(row(r["bl"], r["br"]))).otherwise(F.array().cast("array<string>")))))
    lines = F.concat(F.array(row(top["hl"], top["hr"]), F.lit("| --- | --- |"), row(top["bl"], top["br"])), more)
    return x.select("page", F.array_join(lines, "\n").alias("comparison"))


def page_texts(glyphs: DataFrame, width: float = 595.0) -> DataFrame:
    """page, layout and text of each page, in reading order.

    glyphs: page, glyph_no (in the order of the file), x0, x1, top, bottom, text,
    size, bold, italic; those outside the page, without a page or without text are left out. What a
    page's parts hold is marked, joined over wrapped lines and put in order: what
    spans the columns, then column by column. Three columns or more become a table
    of cards (layout grid), two with parallel sections one that compares them
    (comparison); columns that are read off a drawing are left out (drawing). Page
    number, banner and title come first.

    Lines are found by bands of the page, and stretches of lines, their texts and
    the joins are rows: a page of any number of glyphs is spread out until its
    text is put together, which is one row.
    """
    scratch = Scratch(glyphs.sparkSession, "pages")
    x = glyphs.where("page is not null and top >= 0 and bottom >= top and x0 >= 0 and text is not null").select("page", "glyph_no", "x0", "x1", "top", "bottom", "text", "size", F.coalesce("bold", F.lit(False)).alias("bold"), F.coalesce("italic", F.lit(False)).alias("italic"))
    x, pages = streams(x, scratch, width)
    items = x.where("kept").drop("kept").join(pages.select("page", "columns"), "page")
    # without columns there is one stream
    items = items.withColumn("stream", F.when(F.col("columns"), F.col("stream")).otherwise(0))
    items = scratch.save(wrapped(items.withColumn("seq", F.struct("line_top", "line_no", "segment_no")), ["page", "stream"], ["seq"]), "items")
    scratch.drop("parts", "streams")
    w = words(F.col("text"))
    side = F.when(F.col("stream") >= 2, w)
    letters = F.aggregate(w, F.lit(0), lambda a, t: a + F.length(t))
    seen = items.groupBy("page").agg(
        F.sum(F.coalesce(F.size(side), F.lit(0))).alias("n"),
        F.sum(F.when(F.col("stream") >= 2, F.size(F.filter(w, lambda t: F.length(t) <= 2))).otherwise(0)).alias("short"),
        F.sum(F.when(F.col("stream") >= 2, letters).otherwise(0)).alias("letters"),
    )
    rate = F.col("short") / F.col("n")
    mean = F.col("letters") / F.col("n")
    drawn = (F.col("n") > 0) & (((rate > F.when(F.col("n_cols") >= 3, 0.35).otherwise(0.4)) & (mean < 3.8)) | ((F.col("n") <= 3) & (mean <= 3.0)))
    told = pages.join(seen, "page").withColumn("drawn", F.when(F.col("n") > 0, drawn).otherwise(False) & F.col("columns"))
    two = comparison(items.join(told.where("columns and n_cols < 3").select("page"), "page", "left_semi").where("stream > 0"))
    told = scratch.save(told.join(two, "page", "left").select("page", "n_cols", "columns", "comparison", F.when(F.col("comparison").isNotNull(), "comparison").when(F.col("drawn"), "drawing").when(F.col("n_cols") >= 3, "grid").when(F.col("columns"), "columns").otherwise("text").alias("layout")), "told")
    merged = items.groupBy("page", "stream", "item_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda r: r["text"]), " ").alias("text"), F.min_by("level", "seq").alias("level"))
    merged = merged.join(told, "page").where("not (layout = 'drawing' and stream >= 2) and layout <> 'comparison'").select("page", "stream", F.struct("item_no", F.lit(None).cast(items.schema["seq"].dataType).alias("seq")).alias("at"), "text", "level")
    # a comparison's head isn't joined
    heads = items.where("stream = 0").join(told.where("layout = 'comparison'").select("page"), "page", "left_semi").select("page", "stream", F.struct(F.lit(0).cast("long").alias("item_no"), "seq").alias("at"), "text", "level")
    all_ = merged.unionByName(heads)
    in_order = lambda of: F.transform(F.sort_array(F.collect_list(F.when(of, F.struct("stream", "at", "text", "level")))), lambda r: F.struct(r["stream"].alias("stream"), headed(r["text"], r["level"]).alias("marked"), r["text"].alias("text")))
    x = told.join(all_.groupBy("page").agg(in_order(F.lit(True)).alias("all")), "page", "left").withColumn("all", F.coalesce("all", F.array().cast("array<struct<stream:int,marked:string,text:string>>")))
    inline = F.transform(F.filter("all", lambda r: (F.col("layout") != "grid") | (r["stream"] == 0)), lambda r: r["marked"])
    of_column = lambda k: F.transform(F.filter("all", lambda r: r["stream"] == k), lambda r: r["text"])
    numbers = F.sequence(F.lit(1), F.col("n_cols"))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    card = lambda k: F.coalesce(F.get(of_column(k), F.lit(0)), F.lit(""))
    below = lambda k: F.array_join(F.slice(of_column(k), F.lit(2), F.greatest(F.size(of_column(k)) - 1, F.lit(0))), "<br>")
    cards = F.concat_ws("\n", line(F.transform(numbers, card)), line(F.transform(numbers, lambda k: F.lit("---"))), line(F.transform(numbers, below)))
    block = F.when(F.col("layout") == "grid", F.array(cards)).when(F.col("layout") == "comparison", F.array("comparison")).otherwise(F.array().cast("array<string>"))
    return x.select("page", "layout", F.array_join(F.concat(header_first(inline), block), "\n\n").alias("text"))


def card_tables(rows: DataFrame) -> DataFrame:
    """Tables (doc_id, table_no, row_no, cells) of one filled row with cells of
    several lines: title, header, body and verdict, cards or rejected. Others are
    kept as they are and have none of these (verdict kept).

    Single numbers on top of a cell, short capital remnants, and the first line of
    the first tall cell between two others, the cards' title, are taken off; the
    first line left is the card's heading. Headings that begin in lower case,
    begin or end with a loose word or are longer than five words are no cards.
    """
    filled = F.exists(F.coalesce("cells", F.array().cast("array<string>")), lambda c: strip(F.coalesce(c, F.lit(""))) != "")
    x = rows.groupBy("doc_id", "table_no").agg(F.count_if(filled).alias("n"), F.min_by("cells", F.when(filled, F.col("row_no"))).alias("cells"))
    tail = lambda c: F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))
    first = lambda c: F.coalesce(F.get(c, F.lit(0)), F.lit(""))
    lines = F.transform("cells", lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), strip), lambda t: t != ""))
    x = x.withColumn("lines", F.when(F.col("n") == 1, lines).otherwise(F.array().cast("array<array<string>>")))
    x = x.withColumn("made", (F.size("lines") >= 2) & F.exists("lines", lambda c: F.size(c) >= 2))
    x = x.withColumn("lines", F.transform("lines", lambda c: F.when(first(c).rlike(r"(?iU)^\s*(\d{1,3}|p\.\s*\d+|[①②③④⑤⑥⑦⑧⑨⑩❶❷❸❹❺❻❼❽❾❿])\s*$"), tail(c)).otherwise(c)))
    x = x.withColumn("lines", F.transform("lines", lambda c: F.when((F.size(c) >= 3) & capitals(first(c)) & ((F.size(words(first(c))) <= 2) | (F.length(first(c)) <= 5)), tail(c)).otherwise(c)))
    tall = F.array_position(F.transform("lines", lambda c, i: (F.size(c) >= 3) & (i > 0) & (i < F.size("lines") - 1)), F.lit(True))
    x = x.withColumn("tall", F.when(F.size("lines") >= 3, tall).otherwise(0))
    x = x.withColumn("title", F.when(F.col("made") & (F.col("tall") > 0), first(F.get("lines", F.col("tall").cast("int") - 1))))
    x = x.withColumn("lines", F.transform("lines", lambda c, i: F.when(i + 1 == F.col("tall"), tail(c)).otherwise(c)))
    x = x.withColumns({"header": F.transform("lines", first), "body": F.transform("lines", lambda c: F.array_join(tail(c), "<br>"))})
    loose = lambda w: F.lower(w).isin(LOOSE)
    last = lambda h: F.coalesce(F.element_at(words(h), -1), F.lit(""))
    bad = F.exists("header", lambda h: (h != "") & (h.rlike(r"^\p{Ll}") | loose(first(words(h))) | loose(last(h)) | (F.length(last(h)) <= 1) | (F.size(words(h)) > 5)))
    verdict = F.when(~F.col("made"), "kept").when(bad, "rejected").otherwise("cards")
    x = x.withColumn("verdict", verdict)
    only = lambda c: F.when(F.col("verdict") == "cards", F.col(c)).alias(c)
    return x.select("doc_id", "table_no", "verdict", only("title"), only("header"), only("body"))
