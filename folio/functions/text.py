"""Column expressions on text: all of them run inside Spark's own operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = r"^[|\s:-]+$"
#: Names that Windows keeps for devices.
DEVICES = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?$"


def sub(x: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(x, F.lit(pattern), F.lit(to))


def strip(x: Column) -> Column:
    """Without white space at both ends; Spark's trim only takes spaces."""
    return sub(x, r"^\s+|\s+$", "")


def capture(x: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null without one."""
    return F.nullif(F.regexp_extract(x, pattern, group), F.lit(""))


def is_separator(line: Column) -> Column:
    return strip(line).rlike(SEPARATOR)


def split_row(line: Column, compat: bool = False) -> Column:
    """The trimmed cells of a table row. compat splits at escaped pipes too and
    loses empty cells at the edges; otherwise one pipe at either edge is the frame."""
    inner = sub(strip(line), r"^\|+|\|+$", "") if compat else sub(strip(line), r"^\|", "")
    if compat:
        return F.transform(F.split(inner, r"\|"), strip)
    hidden = F.replace(inner, F.lit("\\|"), F.lit("\x01"))
    hidden = sub(hidden, r"\|$", "")
    return F.transform(F.split(hidden, r"\|"), lambda c: F.replace(strip(c), F.lit("\x01"), F.lit("|")))


def pad(cells: Column, width: Column) -> Column:
    return F.concat(cells, F.array_repeat(F.lit(""), F.greatest(width - F.size(cells), F.lit(0)).cast("int")))


def table_line(cells: Column) -> Column:
    """A Markdown table row: line ends become <br>, pipes are escaped."""
    clean = F.transform(cells, lambda c: F.replace(sub(F.coalesce(c, F.lit("")), r"\r?\n", "<br>"), F.lit("|"), F.lit("\\|")))
    return F.concat(F.lit("| "), F.array_join(clean, " | "), F.lit(" |"))


def rule_line(width: Column) -> Column:
    return F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), width.cast("int")))


def drop_images(x: Column) -> Column:
    """Images become their alternative text in brackets."""
    x = sub(x, r'<p[^>]*>\s*<img[^>]*alt="([^"]*)"[^>]*>\s*</p>', "[$1]")
    x = sub(x, r"<img[^>]*>", "[Image]")
    return sub(x, r"!\[([^\]]*)\]\([^)]*\)", "[$1]")


def drop_styles(x: Column) -> Column:
    """Without emphasis marks, struck or underlined tags, code marks and link targets."""
    x = sub(x, r"\[([^\]]*)\]\([^)]*\)", "$1")
    for mark in (r"\*\*\*(.+?)\*\*\*", r"\*\*(.+?)\*\*", r"\*(.+?)\*", r"~~(.+?)~~", r"<u>(.+?)</u>", r"`(.+?)`"):
        x = sub(x, mark, "$1")
    return x


def csv_cell(x: Column) -> Column:
    """A cell safe for a spreadsheet: plain text, bullets as signs, and an
    apostrophe before what would be read as a formula."""
    # inside an array of one the cleaned text is made once for all its uses
    safe = lambda c: F.when(c.rlike(r"^[-*] "), F.concat(F.lit("• "), F.substring(c, 3, 1 << 30))).when(c.rlike(r"^[=+@-]"), F.concat(F.lit("'"), c)).otherwise(c)
    return F.transform(F.array(strip(drop_styles(drop_images(x)))), safe)[0]


def flat_cell(x: Column) -> Column:
    """A sheet cell: images as text, no links, no style characters, bullets as signs."""
    x = sub(sub(x, r"!\[([^\]]*)\]\([^)]*\)", "[$1]"), r"\[([^\]]*)\]\([^)]*\)", "$1")
    return sub(sub(sub(x, r"^\s*[-*] ", "• "), r"[*_~`]", ""), r"^\s+|\s+$", "")


def wrap_style(x: Column, bold: Column, italic: Column, strike: Column, underline: Column, code: Column) -> Column:
    """Marks around the text inside its outer white space; code goes innermost."""
    middle = strip(x)
    out = middle
    for on, a, b in ((bold, "**", "**"), (italic, "*", "*"), (strike, "~~", "~~"), (underline, "<u>", "</u>"), (code, "`", "`")):
        out = F.when(on, F.concat(F.lit(a), out, F.lit(b))).otherwise(out)
    return F.when(middle == "", x).otherwise(F.concat(F.regexp_extract(x, r"^(\s*)", 1), out, F.regexp_extract(x, r"(\s*)$", 1)))


def timestamp_text(seconds: Column) -> Column:
    """mm:ss, and hh:mm:ss from an hour on."""
    s = F.floor(seconds).cast("long")
    two = lambda v: F.when(v < 10, F.concat(F.lit("0"), v.cast("string"))).otherwise(v.cast("string"))
    h, m = F.expr("0L") + F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.concat(F.when(h > 0, F.concat(two(h), F.lit(":"))).otherwise(""), two(m), F.lit(":"), two(s % 60))


def timestamp_seconds(text: Column) -> Column:
    """The inverse of timestamp_text; null for anything else."""
    parts = F.split(text, ":")
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: acc * 60 + p.cast("long"))
    return F.when(text.rlike(r"^\d{1,}:\d{2}(:\d{2})?$"), number)


def video_id(url: Column) -> Column:
    """The 11 characters that name a video in its usual addresses, or alone."""
    tail = r"([A-Za-z0-9_-]{11})(?:[^A-Za-z0-9_-]|$)"
    return F.coalesce(capture(url, r"(?:youtu\.be/|/embed/|/shorts/|/live/|/v/)" + tail), capture(url, r"youtube\.com/watch\?(?:[^#]*&)?v=" + tail), capture(url, r"^([A-Za-z0-9_-]{11})$"))


def drive_id(url: Column) -> Column:
    return F.coalesce(capture(url, r"/file/d/([A-Za-z0-9_-]+)"), capture(url, r"[?&]id=([A-Za-z0-9_-]+)"))


def filename_problem(name: Column) -> Column:
    """Why a name can't be a file's, null if it can."""
    return (
        F.when(F.coalesce(strip(name), F.lit("")) == "", "empty")
        .when(name.rlike(r"^\s|[\s.]$"), "edge")
        .when(F.length(name) > 255, "long")
        .when(name.rlike(r'[<>:"/\\|?*\x00-\x1f]'), "character")
        .when(name.rlike(DEVICES), "device")
    )


def link_kind(url: Column) -> Column:
    """How the target of a link is opened."""
    return (
        F.when(url.rlike(r"^yt://"), "player")
        .when(url.rlike(r"^#"), "anchor")
        .when(url.rlike(r"^mailto:"), "mail")
        .when(url.rlike(r"(?i)^https?://([a-z.]*\.)?(youtube\.com|youtu\.be)/"), "video")
        .when(url.rlike(r"(?i)^https?://drive\.google\.com/"), "drive")
        .when(url.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), "web")
        .when(url.rlike(r"(?i)\.(md|csv|xlsx|docx|pptx|pdf|html?|json|ya?ml)(#.*)?$"), "document")
        .otherwise("file")
    )


def coerced(x: Column) -> Column:
    """A scalar read from text, as a struct that keeps its kind apart: kind and
    value. Only plain integers and decimals are numbers; dates, addresses and
    versions stay text. Escaped line ends and tabs are read."""
    low = F.lower(x)
    kind = (
        F.when(x.isNull() | low.isin("null", "none", "~"), "null")
        .when(low.isin("true", "false"), "boolean")
        .when(x.rlike(r"^-?\d+$"), "integer")
        .when(x.rlike(r"^-?\d+\.\d+$"), "float")
        .when(x.rlike(r"^(\[.*\]|\{.*\})$"), "json")
        .otherwise("string")
    )
    text = F.replace(F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t")), F.lit("\\r"), F.lit("\r"))
    whole = sub(sub(x, r"^(-?)0+(\d)", "$1$2"), "^-0$", "0")
    value = F.when(kind == "boolean", low).when(kind == "integer", whole).when(kind.isin("float", "json"), x).when(kind == "string", text)
    return F.struct(kind.alias("kind"), value.alias("value"))


def image_markup(src: Column, alt: Column, width: Column, align: Column) -> Column:
    """Markdown for an image, HTML where a width or an alignment is asked for."""
    tag = F.concat(F.lit('<img src="'), src, F.lit('" alt="'), alt, F.lit('"'), F.when(width != "", F.concat(F.lit(' width="'), width, F.lit('"'))).otherwise(""), F.lit(">"))
    return F.when((width == "") & (align == ""), F.concat(F.lit("!["), alt, F.lit("]("), src, F.lit(")"))).when(align == "", tag).otherwise(F.concat(F.lit('<p align="'), align, F.lit('">'), tag, F.lit("</p>")))


def scaled(width: Column, height: Column, to: Column) -> Column:
    """(w, h) of an image at "50%" or "800", the sides kept in proportion; sizes
    that aren't known count as 800 by 600."""
    w, h = F.coalesce(width, F.lit(800)).cast("double"), F.coalesce(height, F.lit(600)).cast("double")
    share = F.when(to.rlike(r"^\d+(\.\d+)?%$"), F.regexp_extract(to, r"^(.*)%$", 1).cast("double") / 100).when(to.rlike(r"^\d+$"), to.cast("double") / w).otherwise(1.0)
    return F.struct(F.bround(w * share).cast("int").alias("w"), F.bround(h * share).cast("int").alias("h"))


def roman_repaired(x: Column) -> Column:
    """A Roman number as read by OCR, with the look-alikes of I put right."""
    return F.upper(F.translate(x, "Ïïl|", "IIII"))


def swapped_extension(path: Column, ext: Column) -> Column:
    return F.concat(sub(path, r"\.[^./]*$", ""), ext)


def word_shape(x: Column) -> Column:
    """(n, short share, mean length) of the words of a text."""
    words = F.filter(F.split(x, r"\s+"), lambda w: w != "")
    n = F.size(words)
    return F.struct(n.alias("n"), (F.size(F.filter(words, lambda w: F.length(w) <= 2)) / F.greatest(n, F.lit(1))).alias("short"), (F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w)) / F.greatest(n, F.lit(1))).alias("mean"))
