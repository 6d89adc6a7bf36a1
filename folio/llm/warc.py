"""WARC derivatives: metadata and plain-text conversion records of responses."""

from __future__ import annotations

import json
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.names import column, unused

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
RECORD = "page_id, warc_type, record_id, refers_to, target_uri, content_type, content_length, block_digest, payload_digest, header, block"

#: From markup to text, in this order: what goes, and what becomes a line's end.
STEPS: list[tuple[str, str]] = [
    (r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<title\b.*?</title\s*>|<!--.*?-->", " "),
    (r"(?i)</?(?:p|div|h[1-6]|li|ul|ol|br|hr|tr|table|article|section|nav|header|footer|blockquote|pre|body)\b[^>]*>", "\n"),
    (r"</?[A-Za-z!][^>]*>", ""),
]
#: What holds no title, language or link of a page, as it is never shown; a title is text, whatever it holds.
SILENT = r"(?is)(<title\b.*?</title\s*>)|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
#: A character's name or number, after its ampersand.
REFERENCE = "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
#: Code points by name, as the standard library has them.
NAMED = {**name2codepoint, "apos": 39}
TIDY = [(r"[ \t\r\f\x{a0}]+", " "), (r" ?\n[ \n]*", "\n")]
#: The same for Java's engine: what can't begin a match is passed over at once, and what would be replaced by itself isn't matched.
QUICK = {
    **{p: f"{p[:5]}(?=<)(?:{p[5:]})" for p in (STEPS[0][0], SILENT)},
    TIDY[0][0]: r"[ \t\r\f\x{a0}]{2,}|[\t\r\f\x{a0}]",
    TIDY[1][0]: r" \n[ \n]*|\n[ \n]+",
}
#: An attribute's value with its quotes, if it has any.
VALUE = r"""\s*=\s*("[^"]*"|'[^']*'|[^\s>"'][^\s>]*)"""
QUOTES = """^["']|["']$"""
TITLE, CHARSET = r"(?is)<title\b[^>]*>(.*?)</title", r"(?i)<meta\b[^>]*\bcharset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)"
LANG, LINK = r"(?i)<html\b[^>]*?[\s\"'/]lang" + VALUE, r"(?i)<a\b[^>]*?[\s\"'/]href" + VALUE


def decoded(text: Column) -> Column:
    """Character references read once, by name or number; others stay. Numbers that
    are no characters become U+FFFD."""
    names = F.from_json(F.lit(json.dumps(NAMED)), "map<string,int>")

    def read(found: Column, at: Column) -> Column:
        part, ref = found["part"], found["ref"]
        number = F.when(F.lower(F.substring(ref, 1, 2)) == "#x", F.conv(F.substr(ref, F.lit(3)), 16, 10)).when(ref.startswith("#"), F.substr(ref, F.lit(2)))
        code = F.when(ref.startswith("#"), number.cast("int")).otherwise(F.try_element_at(names, ref))
        code = F.when((code < 1) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), 0xFFFD).otherwise(code)
        sign = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(at == 0, part).when((ref == "") | code.isNull(), F.concat(F.lit("&"), part)).otherwise(F.concat(sign, F.substr(part, F.length(ref) + 2)))

    parts = F.transform(F.split(text, "&"), lambda part: F.struct(part.alias("part"), F.regexp_extract(part, REFERENCE, 1).alias("ref")))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(parts, read), "")).otherwise(text)


def unquoted(value: Column) -> Column:
    return F.regexp_replace(value, F.lit(QUOTES), F.lit(""))


def replaced(text: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(text, F.lit(QUICK.get(pattern, pattern)), F.lit(to))


def without_markup(html: Column) -> Column:
    """A page without scripts, styles, title, comments and tags; block tags end a line."""
    for pattern, to in STEPS:
        html = replaced(html, pattern, to)
    return html


def plain_text(markup: Column) -> Column:
    """The text of without_markup(): character references are read, white space is
    tidied. It reads its column several times, so that is better a stored one."""
    text = decoded(markup)
    for pattern, to in TIDY:
        text = replaced(text, pattern, to)
    return F.btrim(text, F.lit(" \n"))


def _urn(kind: str, *parts: Column) -> Column:
    """A record id that only depends on its parts, in the form of a UUID."""
    h = F.md5(F.concat_ws("\n", F.lit(kind), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _digest(x: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(x.cast("binary"), 256))


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """Response records of fetched pages: id, record_id, target_uri, date, the
    source's HTTP header, payload and its digest. Null addresses and pages count as empty."""
    html = F.coalesce(column(html_col), F.lit(""))
    url = F.coalesce(column(url_col), F.lit(""))
    return pages.select(
        column(id_col).alias("page_id"),
        _urn("response", column(id_col), url, _digest(html)).alias("record_id"),
        url.alias("target_uri"),
        F.lit(date).alias("date"),
        F.concat(F.lit(HTTP), F.octet_length(html).cast("string"), F.lit("\r\n\r\n")).alias("http_header"),
        html.alias("payload"),
        _digest(html).alias("payload_digest"),
    )


def derive(records: DataFrame) -> DataFrame:
    """For each response record a metadata and a conversion record, linked by
    WARC-Refers-To and with the source's address, date and digest.

    header and block make up the record as it stands in a file; content_length
    counts the block's bytes. The metadata block holds title, language, charset,
    the source's HTTP status and all its HTTP fields, its payload's digest, and each
    outlink in order; attributes may be quoted either way or not at all, and what
    stands in scripts, styles and comments is none of the page's. The header
    has the digests of the record itself and that of the source's payload. Equal
    responses give equal records, so repeated rows can be told by their ids. Pages
    without any text get an empty conversion block.
    """
    live, bare, title, lang, charset, text = unused(records.columns, "live", "bare", "title", "lang", "charset", "text")
    # what is read more than once is a column, as an expression would be worked out each time
    records = records.withColumns({live: replaced(F.col("payload"), SILENT, "$1 "), bare: without_markup(F.col("payload"))})
    records = records.withColumns({c: F.regexp_extract(live, p, 1) for c, p in ((title, TITLE), (lang, LANG), (charset, CHARSET))} | {text: plain_text(F.col(bare))})
    tidy = lambda x: F.btrim(F.regexp_replace(x, r"[ \t\r\n\f]+", " "))
    field = lambda name, x: F.when(x != "", F.concat(F.lit(f"{name}: "), x, F.lit("\r\n"))).otherwise("")
    links = F.array_join(F.transform(F.transform(F.regexp_extract_all(live, F.lit(LINK), 1), unquoted), lambda u: F.concat(F.lit("outlink: "), tidy(decoded(u)), F.lit(" L a/@href\r\n"))), "")
    http = F.array_join(F.transform(F.regexp_extract_all("http_header", F.lit(r"\r\n([^:\r\n]+:[^\r\n]*)"), 1), lambda x: F.concat(F.lit("http-"), F.lower(F.substring_index(x, ":", 1)), F.lit(": "), F.btrim(F.substr(x, F.instr(x, ":") + 1)), F.lit("\r\n"))), "")
    meta = F.concat(
        field("title", tidy(decoded(F.col(title)))),
        field("language", tidy(decoded(unquoted(F.col(lang))))),
        field("charset", F.col(charset)),
        field("http-status", F.regexp_extract("http_header", r"^HTTP/[0-9.]+ ([0-9]+)", 1)),
        http,
        field("source-digest", F.col("payload_digest")),
        links,
    )
    both = records.withColumn(
        "made",
        F.explode(
            F.array(
                F.struct(F.lit("metadata").alias("kind"), F.lit("application/warc-fields").alias("type"), meta.alias("block")),
                F.struct(F.lit("conversion").alias("kind"), F.lit("text/plain; charset=utf-8").alias("type"), F.col(text).alias("block")),
            )
        ),
    )
    x = both.select("page_id", F.col("made.kind").alias("warc_type"), _urn("derived", F.col("made.kind"), F.col("record_id")).alias("record_id"), F.col("record_id").alias("refers_to"), "target_uri", "date", F.col("made.type").alias("content_type"), "payload_digest", F.col("made.block").alias("block"))
    x = x.withColumns({"content_length": F.octet_length("block").cast("long"), "block_digest": _digest(F.col("block"))})
    lines = [("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "date"), ("WARC-Target-URI", "target_uri"), ("WARC-Refers-To", "refers_to"), ("WARC-Refers-To-Target-URI", "target_uri"), ("WARC-Refers-To-Date", "date"), ("WARC-Refers-To-Payload-Digest", "payload_digest"), ("WARC-Block-Digest", "block_digest"), ("WARC-Payload-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    header = F.concat(F.lit(f"{VERSION}\r\n"), *(F.concat(F.lit(f"{name}: "), F.col(c).cast("string"), F.lit("\r\n")) for name, c in lines), F.lit("\r\n"))
    return x.withColumn("header", header).select(*RECORD.split(", "))


def _sql(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\r", "' || chr(13) || '").replace("\n", "' || chr(10) || '") + "'"


def oracle() -> str:
    """derive(responses(pages)) in DuckDB's SQL."""
    names = "MAP {" + ", ".join(f"'{n}': {c}" for n, c in NAMED.items()) + "}"

    def read(text: str) -> str:
        ref, code = f"regexp_extract(p, {_sql(REFERENCE)}, 1)", "CASE WHEN lower(ref[1:2]) = '#x' THEN ('0x' || ref[3:])::INT WHEN ref[1] = '#' THEN ref[2:]::INT ELSE names[ref] END"
        code = f"list_transform([{code}], lambda c: CASE WHEN c < 1 OR c > 1114111 OR c BETWEEN 55296 AND 57343 THEN 65533 ELSE c END)[1]"
        one = f"list_transform([{ref}], lambda ref: list_transform([{code}], lambda code: CASE WHEN ref = '' OR code IS NULL THEN '&' || p ELSE chr(code) || p[length(ref) + 2:] END)[1])[1]"
        return f"array_to_string(list_transform(string_split({text}, '&'), lambda p, i: CASE WHEN i = 1 THEN p ELSE {one} END), '')"

    text = "html"
    for pattern, to in STEPS:
        text = f"regexp_replace({text}, {_sql(pattern)}, {_sql(to)}, 'g')"
    text = read(text)
    for pattern, to in TIDY:
        text = f"regexp_replace({text}, {_sql(pattern)}, {_sql(to)}, 'g')"
    urn = lambda h: f"'<urn:uuid:' || substr({h},1,8) || '-' || substr({h},9,4) || '-' || substr({h},13,4) || '-' || substr({h},17,4) || '-' || substr({h},21,12) || '>'"
    field = lambda name, x: f"CASE WHEN {x} <> '' THEN '{name}: ' || {x} || chr(13) || chr(10) ELSE '' END"
    get = lambda p: f"regexp_extract(live, {_sql(p)}, 1)"
    tidy = lambda x: f"trim(regexp_replace({x}, '[ \\t\\r\\n\\f]+', ' ', 'g'))"
    bare = lambda x: f"regexp_replace({x}, {_sql(QUOTES)}, '', 'g')"
    links = f"array_to_string(list_transform(regexp_extract_all(live, {_sql(LINK)}, 1), lambda u: 'outlink: ' || {tidy(read(bare('u')))} || ' L a/@href' || chr(13) || chr(10)), '')"
    http = [field("http-status", "'200'"), field("http-content-type", "'text/html; charset=utf-8'"), field("http-content-length", "strlen(html)::VARCHAR")]
    meta = " || ".join([field("title", tidy(read(get(TITLE)))), field("language", tidy(read(bare(get(LANG))))), field("charset", get(CHARSET)), *http, field("source-digest", "payload_digest"), links])
    lines = [("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", f"'{DATE}'"), ("WARC-Target-URI", "target_uri"), ("WARC-Refers-To", "refers_to"), ("WARC-Refers-To-Target-URI", "target_uri"), ("WARC-Refers-To-Date", f"'{DATE}'"), ("WARC-Refers-To-Payload-Digest", "payload_digest"), ("WARC-Block-Digest", "block_digest"), ("WARC-Payload-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    header = f"{_sql(VERSION)} || chr(13) || chr(10) || " + " || ".join(f"'{n}: ' || {c} || chr(13) || chr(10)" for n, c in lines) + " || chr(13) || chr(10)"
    return f"""
    WITH p AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS html, {names} AS names FROM pages),
    d AS (SELECT *, 'sha256:' || sha256(html) AS payload_digest FROM p),
    r AS (SELECT *, md5('response' || chr(10) || coalesce(page_id::VARCHAR, '') || chr(10) || target_uri || chr(10) || payload_digest) AS h FROM d),
    s AS (SELECT *, {urn("h")} AS refers_to, regexp_replace(html, {_sql(SILENT)}, '\\1 ', 'g') AS live FROM r),
    m AS (SELECT page_id, 'metadata' AS warc_type, refers_to, target_uri, 'application/warc-fields' AS content_type, payload_digest, {meta} AS block FROM s
          UNION ALL SELECT page_id, 'conversion', refers_to, target_uri, 'text/plain; charset=utf-8', payload_digest, trim({text}, ' ' || chr(10)) FROM s),
    n AS (SELECT *, md5('derived' || chr(10) || warc_type || chr(10) || refers_to) AS g FROM m),
    o AS (SELECT *, {urn("g")} AS record_id, strlen(block) AS content_length, 'sha256:' || sha256(block) AS block_digest FROM n)
    SELECT page_id, warc_type, record_id, refers_to, target_uri, content_type, content_length, block_digest, payload_digest, {header} AS header, block FROM o"""
