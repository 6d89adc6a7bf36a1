"""Open tabs, stored settings, edits of texts, and pages put together from their parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions.text import strip


def first_filled(*texts: Column) -> Column:
    """The first of several texts that isn't blank: a draft before what it was made of."""
    return F.coalesce(*(F.when(strip(t) != "", t) for t in texts))


def stored(rows: DataFrame, known: dict[str, str], json_col: str = "json") -> DataFrame:
    """rows with a column for each known key of their JSON object, its default where
    the key is missing or the text can't be read; other keys are left out."""
    read = F.try_parse_json(F.col(json_col))
    return rows.select(*(c for c in rows.columns if c != json_col), *(F.coalesce(F.try_variant_get(read, f"$.{k}", "string"), F.lit(v)).alias(k) for k, v in known.items()))


def active_after_close(tabs: DataFrame, closed: DataFrame) -> DataFrame:
    """window and active: the tab that is active once one has been closed. tabs:
    window, place from 0, tab; closed: window, tab, active. A closed tab that isn't
    open changes nothing; if it was active, the one that moves to its place becomes
    it, at the end the last one, and null if none is left."""
    x = closed.select("window", F.col("tab").alias("_gone"), F.col("active").alias("_was"))
    all_ = tabs.join(x, "window").groupBy("window", "_gone", "_was").agg(F.max(F.when(F.col("tab") == F.col("_gone"), F.col("place"))).alias("_at"), F.max("place").alias("_last"))
    to = F.least(F.col("_at"), F.col("_last") - 1)
    # counted without the closed one
    heir = all_.withColumn("place", F.when(to >= F.col("_at"), to + 1).otherwise(to)).join(tabs.select("window", "place", "tab"), ["window", "place"], "left")
    return heir.select("window", F.when(F.col("_at").isNull() | (F.col("_was") != F.col("_gone")), F.col("_was")).otherwise(F.col("tab")).alias("active"))


def reordered(tabs: DataFrame, moves: DataFrame) -> DataFrame:
    """tabs (window, place, tab) after one of each window has been taken to the place
    of another. moves: window, source, target."""
    at = lambda c: F.max(F.when(F.col("tab") == F.col(c), F.col("place"))).over(W.partitionBy("window"))
    x = tabs.join(moves, "window", "left").withColumns({"_from": at("source"), "_to": at("target")})
    p, a, b = F.col("place"), F.col("_from"), F.col("_to")
    place = F.when(a.isNull() | b.isNull() | (a == b), p).when(p == a, b).when((a < b) & p.between(a + 1, b), p - 1).when((a > b) & p.between(b, a - 1), p + 1).otherwise(p)
    return x.select("window", place.alias("place"), "tab")


def history(files: DataFrame, folders: DataFrame, cap: int | None = None) -> DataFrame:
    """Files and folders as one list: pinned ones first, then the latest."""
    both = files.withColumn("kind", F.lit("file")).unionByName(folders.withColumn("kind", F.lit("folder")))
    order = both.orderBy(F.col("pinned").desc(), F.col("last_opened").desc(), "path")
    return order.limit(cap) if cap else order


def pins_toggled(items: DataFrame, paths: DataFrame) -> DataFrame:
    """items (path, pinned) with the pins of some paths turned."""
    x = items.join(paths.select("path", F.lit(True).alias("_hit")).distinct(), "path", "left")
    return x.withColumn("pinned", F.col("pinned") != F.coalesce("_hit", F.lit(False))).drop("_hit")


def removed(items: DataFrame, paths: DataFrame) -> DataFrame:
    return items.join(paths.select("path").distinct(), "path", "left_anti")


def locales(files: DataFrame, json_col: str = "json") -> DataFrame:
    """code, name and native_name of locale files (code, json); the code stands for
    what a file doesn't say or can't be read."""
    read = F.try_parse_json(F.col(json_col))
    of = lambda k: F.coalesce(F.try_variant_get(read, f"$._meta.{k}", "string"), F.col("code")).alias(k)
    return files.select("code", of("name"), of("native_name"))


def hardware_summary(cpu: Column, cores: Column, mhz: Column, ram: Column, gpu: Column, vram_mb: Column) -> Column:
    """One line about a machine; parts that aren't known are left out."""
    speed = F.when(mhz > 0, F.concat(F.lit(" @ "), F.format_string("%.1f", mhz / 1000.0), F.lit("GHz"))).otherwise("")
    card = F.when(F.coalesce(gpu, F.lit("")) == "", "CPU/Integrated Graphics").when(vram_mb > 0, F.concat(gpu, F.lit(" ("), F.format_string("%.1f", vram_mb / 1024), F.lit("GB VRAM)"))).otherwise(gpu)
    return F.concat(cpu, F.lit(" ("), cores.cast("string"), F.lit(" Cores"), speed, F.lit(") | "), F.format_string("%.1f", ram), F.lit("GB RAM | GPU: "), card)


def session_id(path: Column, mtime: Column, size: Column) -> Column:
    """The name of a document's cache: the same for the same file, another once it has changed."""
    return F.substring(F.md5(F.concat_ws("_", path, mtime.cast("string"), size.cast("string")).cast("binary")), 1, 12)


def inserted(text: Column, start: Column, end: Column, new: Column) -> Column:
    """A text with the range start..end (from 0, kept inside the text) replaced."""
    n = F.length(text)
    a = F.greatest(F.lit(0), F.least(start, n))
    b = F.greatest(a, F.least(end, n))
    return F.concat(F.substring(text, F.lit(1), a), new, F.substr(text, b + 1))


def token_replaced(text: Column, start: Column, token: Column, new: Column) -> Column:
    """A text with a token replaced where it is said to stand, else where it is found
    first, else as it was."""
    there = F.substring(text, start + 1, F.length(token)) == token
    at = F.when(there, start).otherwise(F.instr(text, token) - 1)
    return F.when(at < 0, text).otherwise(inserted(text, at, at + F.length(token), new))


def utf16_offset(text: Column, offset: Column) -> Column:
    """How many UTF-16 units stand before an offset that counts no carriage returns."""
    plain = F.replace(text, F.lit("\r"), F.lit(""))
    # the text up to the character at the offset, with the returns between those before it
    pattern = F.concat(F.lit("^((?:\r*[^\r]){0,"), offset.cast("string"), F.lit("})"))
    before = F.when(offset > F.length(plain), text).otherwise(F.call_function("regexp_extract", text, pattern, F.lit(1)))
    return (F.length(F.encode(before, "UTF-16LE")) / 2).cast("int")


def rows_go_on(last: Column, first: Column) -> Column:
    """Whether a table's first row on a page is the rest of the last one before."""
    n = F.size(first)
    open_ = F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda c: (F.get(last, c) == "") & (F.get(first, c) != ""))
    end = F.substring(strip(F.get(last, n - 1)), -1, 1)
    return (F.size(last) == n) & (n > 1) & (F.get(first, F.lit(0)) == "") & (open_ | ((F.get(last, n - 1) != "") & (F.get(first, n - 1) != "") & ~end.isin(".", "!", "?", ":")))


def words_split(cells: Column) -> Column:
    """Whether words seem to be cut between neighbouring cells: brackets that close
    in the next one, a hyphen at the end, or two letters before a lower-case word."""
    return cut_between(F.filter(F.transform(cells, strip), lambda c: c != ""))


def cut_between(filled: Column) -> Column:
    """words_split() of cells that are trimmed and not empty."""
    count = lambda c, s: F.length(c) - F.length(F.replace(c, F.lit(s), F.lit("")))
    after = F.slice(filled, F.lit(2), F.greatest(F.size(filled) - 1, F.lit(0)))
    last, first = lambda c: F.regexp_extract(c, r"(\S+)$", 1), lambda c: F.regexp_extract(c, r"^(\S+)", 1)
    cut = lambda a, b: ((count(a, "(") > count(a, ")")) & (count(b, ")") > count(b, "("))) | a.rlike("[-‐–]$") | (last(a).rlike(r"^\p{L}{1,2}$") & first(b).rlike(r"^\p{Ll}\p{L}*$"))
    pairs = F.zip_with(F.slice(filled, F.lit(1), F.size(after)), after, cut)
    return F.coalesce(F.exists(pairs, lambda x: x), F.lit(False))


def by_top(shapes: DataFrame, by: str = "page") -> DataFrame:
    """Shapes (shape_no, top) with their place on the page; one without a top comes first."""
    return shapes.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(F.coalesce("top", F.lit(0)), "shape_no")))


def text_between(regions: DataFrame, heights: DataFrame, least: float = 2.0) -> DataFrame:
    """Elements of pages in order: tables (page, top, bottom) and the text between
    them, where more than ``least`` is left. heights: page, height."""
    by = W.partitionBy("page").orderBy("top", "bottom")
    above = F.coalesce(F.max("bottom").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    x = regions.withColumn("_above", above)
    tables = x.select("page", F.lit("table").alias("type"), F.col("top").cast("double").alias("from"), F.col("bottom").cast("double").alias("to"))
    gaps = x.where(F.col("top") > F.col("_above") + least).select("page", F.lit("text").alias("type"), F.col("_above").cast("double").alias("from"), F.col("top").cast("double").alias("to"))
    rest = heights.join(regions.groupBy("page").agg(F.max("bottom").alias("_end")), "page", "left").withColumn("_end", F.coalesce("_end", F.lit(0.0)))
    rest = rest.where(F.col("_end") < F.col("height") - least).select("page", F.lit("text").alias("type"), F.col("_end").cast("double").alias("from"), F.col("height").cast("double").alias("to"))
    order = W.partitionBy("page").orderBy(F.when(F.col("type") == "table", F.col("from")).otherwise(F.col("to")), F.col("type").desc(), "to")
    return tables.unionByName(gaps).unionByName(rest).withColumn("elem_no", F.row_number().over(order))


def mean_font_sizes(glyphs: DataFrame) -> DataFrame:
    """The mean size of each line's glyphs (page, line_no, size)."""
    return glyphs.groupBy("page", "line_no").agg(F.avg("size").alias("size"))


def pixel_stats(pixels: DataFrame, by: str = "image") -> DataFrame:
    """Of each image: spread of its channels, mean colour difference, and the shares
    of white and of blank central pixels. pixels: image, row, col, r, g, b, a and
    the image's height and width; nearly transparent ones have no part in the first two."""
    seen = F.col("a") > 20
    n = F.count_if(seen) * 3
    total = F.sum(F.when(seen, F.col("r") + F.col("g") + F.col("b")))
    squares = F.sum(F.when(seen, F.col("r") * F.col("r") + F.col("g") * F.col("g") + F.col("b") * F.col("b")))
    white = (F.col("r") >= 235) & (F.col("g") >= 235) & (F.col("b") >= 235)
    inside = lambda x, of: (x >= F.floor(F.col(of) * 0.25)) & (x < F.floor(F.col(of) * 0.75))
    centre = inside(F.col("row"), "height") & inside(F.col("col"), "width")
    return pixels.groupBy(by).agg(
        F.sqrt(F.greatest(F.lit(0.0), squares / n - (total / n) * (total / n))).alias("std"),
        F.avg(F.when(seen, F.abs(F.col("r") - F.col("g")) + F.abs(F.col("g") - F.col("b")))).alias("colour"),
        (F.count_if(white) / F.count("*")).alias("white"),
        (F.count_if(centre & (white | (F.col("a") < 20))) / F.nullif(F.count_if(centre), F.lit(0))).alias("centre_blank"),
    )


def table_guards(rows: DataFrame) -> DataFrame:
    """doc_id, table_no, problem: why what looks like a table on a page is none, null
    for tables. rows: doc_id, table_no, row_no, cells. Fixed values: the bounds.

    empty, one column or row, a long cell beside an empty one, a paragraph as heading,
    the short words of a drawing, words cut between cells, or a document's headings
    and lists in a cell - the first that fits. Sums of rows are all that is gathered."""
    filled = F.filter(F.transform(F.coalesce("cells", F.array().cast("array<string>")), lambda c: strip(F.coalesce(c, F.lit("")))), lambda c: c != "")
    # each step is a column, as one that is written out wherever it is used would be worked out there again
    rows = rows.withColumn("_filled", filled)
    filled = F.col("_filled")
    rows, words = rows.withColumn("_words", F.filter(F.split(F.array_join(filled, " "), r"\s+"), lambda w: w != "")), F.col("_words")
    inside = F.exists(filled, lambda c: c.rlike(r"(?iu)(?:^|\n)(?:#{1,6}\s+|Phần\s+\d+:|Mục\s+\d+\.\d+:|\d+\.\s+Tệp\s+tin)") | ((F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) > 5) & c.rlike(r"(?:^|\n)\s*[-*○•]")))
    x = rows.select(
        "doc_id",
        "table_no",
        "row_no",
        F.size("cells").alias("width"),
        F.size(filled).alias("filled"),
        (F.exists(filled, lambda c: F.length(c) > 20) & (F.size(filled) < F.size("cells"))).alias("broken"),
        F.exists(filled, lambda c: F.size(F.split(c, r"\s+")) > 15).alias("long"),
        F.size(words).alias("words"),
        F.size(F.filter(words, lambda w: F.length(w) <= 2)).alias("short"),
        F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w)).alias("letters"),
        cut_between(filled).alias("split"),
        inside.alias("inside"),
    )
    n = F.sum("words")
    noise = (n > 0) & (F.sum("short") / n > 0.35) & (F.sum("letters") / n < 3.5)
    problem = (
        F.when(F.sum("filled") == 0, "empty")
        .when(F.max("width") < 2, "columns")
        .when(F.max("broken"), "broken")
        .when(F.count("*") < 2, "rows")
        .when(F.min_by("long", "row_no"), "prose")
        .when(noise, "noise")
        .when(F.max("split"), "split")
        .when(F.max("inside"), "document")
    )
    return x.groupBy("doc_id", "table_no").agg(problem.alias("problem"))


def header_first(texts: Column) -> Column:
    """A slide's texts with its banner, page number and title first, in this order.
    The number stands alone; a banner is a short heading of the third level in
    capitals before anything else; the title is the first heading, if two texts at
    most stand before it."""
    alone = r"^\*{0,2}(\d{1,3})\*{0,2}$"
    none = F.array().cast("array<string>")
    # worked out once a slide; in a lambda over the texts it would be once a text
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))

    def numbered(items: Column, number: Column) -> Column:
        rest = F.filter(items, lambda t: (number == "") | (F.regexp_extract(t, alone, 1) != number))
        return once(rest, lambda rest: bannered(number, rest))

    def bannered(number: Column, rest: Column) -> Column:
        first = F.coalesce(F.get(rest, F.lit(0)), F.lit(""))
        name = F.trim(F.substring(first, 5, 1 << 20))
        has_banner = first.startswith("### ") & (F.upper(name) == name) & (F.lower(name) != name) & (F.size(F.split(name, r"\s+")) <= 4)
        return once(has_banner, lambda has: once(F.when(has, F.slice(rest, F.lit(2), F.greatest(F.size(rest) - 1, F.lit(0)))).otherwise(rest), lambda below: titled(F.when(has, F.array(first)).otherwise(none), number, below)))

    def titled(banner: Column, number: Column, rest: Column) -> Column:
        at = F.array_position(F.transform(rest, lambda t: t.startswith("# ")), F.lit(True)).cast("int")
        marked = F.when(number != "", F.array(F.concat(F.lit("**"), number, F.lit("**")))).otherwise(none)
        n = F.size(rest)
        moved = lambda at: F.concat(banner, marked, F.array(F.get(rest, at - 1)), F.slice(rest, F.lit(1), at - 1), F.slice(rest, at + 1, F.greatest(n - at, F.lit(0))))
        return once(at, lambda at: F.when(at.between(1, 3), moved(at)).otherwise(F.concat(banner, marked, rest)))

    items = F.filter(F.transform(texts, strip), lambda t: t != "")
    number = lambda items: F.coalesce(F.get(F.filter(F.transform(items, lambda t: F.regexp_extract(t, alone, 1)), lambda t: t != ""), F.lit(0)), F.lit(""))
    return once(items, lambda items: once(number(items), lambda number: numbered(items, number)))
