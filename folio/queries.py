"""The registered queries: each operator on the driver's tables, with its SQL.

Files, lists and other inputs that the tables lack are made of them in the query
(a customer's path, an order line as an OCR word), over the whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.functions.html import html_to_markdown
from folio.functions.inline import segments, stripped
from folio.functions.tree import json_to_markdown, markdown_to_json
from folio.operators import catalog, images, layout, lines, pages, preview, rulings, search, splices, tables, transcript, workspace
from folio.plans import convert
from folio.runtime import spread, table
from folio.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


# ---- lines and blocks

LINES_SQL = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL)"
STRIP = r"regexp_replace({0}, '^[\s\x0b]+|[\s\x0b]+$', '', 'g')"
STRIPPED = STRIP.format("line")
SEP = rf"regexp_matches({STRIPPED}, '^[|\s\x0b:-]+$')"


@query(rf"""
WITH {LINES_SQL},
i AS (SELECT *, sum(CASE WHEN line LIKE '%|%' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM l),
t AS (SELECT doc_id, island FROM i WHERE line LIKE '%|%' AND NOT {SEP} GROUP BY ALL HAVING count(*) >= 2),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1)
SELECT d.doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n_lines, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+'), lambda w: w <> '')) AS n_words,
       length(coalesce(text, '')) AS n_chars, coalesce(n, 0) AS n_tables FROM documents d LEFT JOIN n USING (doc_id)""")
def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.stats(table(spark, sf_dir, "documents"))


KIND_SQL = rf"""CASE WHEN {STRIPPED} = '' THEN 'blank' WHEN regexp_matches({STRIPPED}, '^#{{1,6}}\s+\S') THEN 'heading' WHEN regexp_matches({STRIPPED}, '^(-{{3,}}|\*{{3,}}|_{{3,}})$') THEN 'rule'
 WHEN line LIKE '%|%' AND {SEP} THEN 'separator' WHEN line LIKE '%|%' THEN 'table' WHEN regexp_matches({STRIPPED}, '^[-*+•] ') THEN 'bullet' WHEN regexp_matches({STRIPPED}, '^\d+[.)] ') THEN 'number'
 WHEN regexp_matches({STRIPPED}, '^>') THEN 'quote' ELSE 'paragraph' END"""

#: Markdown made of every customer: headings, lists, bold lines, fences, rules.
MARKDOWN_SQL = """m AS (SELECT c_custkey AS doc_id, '# ' || c_name || chr(10) || '- key ' || c_custkey || chr(10) || '- region ' || c_nationkey || chr(10) || '**About**' || chr(10) || 'In region ' || c_nationkey || '.' || chr(10) || '```mermaid' || chr(10) || '# a comment' || chr(10) || 'graph ' || c_name || chr(10) || '```' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Notes' || chr(10) || '1. one' || chr(10) || '> quoted' || chr(10) || '### More' || chr(10) || '![map](maps/' || c_custkey || '.png) and [site](https://example.com/' || c_custkey || ')' AS text FROM customer),
ml AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM m),
mf AS (SELECT *, regexp_matches(line, '^\\s*(```|~~~)') AS is_fence FROM ml),
mc AS (SELECT *, coalesce(sum(is_fence::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS in_code FROM mf)"""


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MARKDOWN_SQL's documents."""
    key = F.col("c_custkey").cast("string")
    parts = ["# ", F.col("c_name"), "\n- key ", key, "\n- region ", F.col("c_nationkey").cast("string"), "\n**About**\nIn region ", F.col("c_nationkey").cast("string"), ".\n```mermaid\n# a comment\ngraph ", F.col("c_name"), "\n```\n\n---\n\n## Notes\n1. one\n> quoted\n### More\n![map](maps/", key, ".png) and [site](https://example.com/", key, ")"]
    return spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")).select(F.col("c_custkey").alias("doc_id"), F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)).alias("text"))


@query(rf"""WITH {MARKDOWN_SQL} SELECT doc_id, line_no, is_fence, in_code, CASE WHEN is_fence THEN 'fence' WHEN in_code THEN 'code' ELSE {KIND_SQL} END AS kind FROM mc""")
def block_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.classified(lines.fenced(lines.lines(markdown(spark, sf_dir)))).select("doc_id", "line_no", "is_fence", "in_code", "kind")


@query(rf"""WITH {LINES_SQL}, k AS (SELECT {KIND_SQL} AS kind FROM l) SELECT kind, count(*) AS n FROM k GROUP BY 1""")
def block_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = lines.lines(table(spark, sf_dir, "documents")).withColumns({"is_fence": F.lit(False), "in_code": F.lit(False)})
    return lines.classified(plain).groupBy("kind").agg(F.count("*").alias("n"))


@query(rf"""WITH {MARKDOWN_SQL}, e AS (SELECT *, regexp_matches({STRIPPED}, '^([-*] |\d+\.\s)') AS item, regexp_matches({STRIPPED}, '^(\*\*|#)') AS head FROM ml),
v AS (SELECT *, CASE WHEN item THEN 'item' WHEN head THEN 'head' END AS event FROM e)
SELECT doc_id, line_no, head AND NOT item AND coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') = 'item' AS blank_before FROM v""")
def list_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.list_breaks(lines.lines(markdown(spark, sf_dir))).select("doc_id", "line_no", "blank_before")


@query(f"WITH {LINES_SQL} SELECT doc_id, line_no, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM l")
def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.offsets(lines.lines(table(spark, sf_dir, "documents"))).select("doc_id", "line_no", "start")


@query(rf"""WITH {MARKDOWN_SQL}, h AS (SELECT *, length(regexp_extract(line, '^(#+)', 1)) AS level FROM mc WHERE NOT is_fence AND NOT in_code AND regexp_matches(line, '^#{{1,6}}\s+\S'))
SELECT doc_id, line_no, level::INT AS level, greatest(1, level - (first_value(level) OVER (PARTITION BY doc_id ORDER BY line_no) - 1))::INT AS toc_level, regexp_replace(line, '^#+\s+', '') AS title FROM h""")
def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.contents(lines.classified(lines.fenced(lines.lines(markdown(spark, sf_dir)))))


@query(rf"""WITH {MARKDOWN_SQL}, s AS (SELECT *, lag(line) OVER w AS a, lead(line) OVER w AS b FROM mc WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
d AS (SELECT *, line = '---' AND coalesce(a, '') = '' AND coalesce(b, '') = '' AND NOT in_code AS dash FROM s),
n AS (SELECT *, sum(dash::INT) OVER (PARTITION BY doc_id ORDER BY line_no) + 1 AS slide_no FROM d)
SELECT doc_id, slide_no::BIGINT AS slide_no, count(*) AS n_lines FROM n WHERE NOT dash GROUP BY 1, 2""")
def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.slides(lines.fenced(lines.lines(markdown(spark, sf_dir)))).groupBy("doc_id", "slide_no").agg(F.count("*").alias("n_lines"))


@query(f"WITH {MARKDOWN_SQL} SELECT doc_id, 0 AS block_no, regexp_extract(text, '(?s)```mermaid[ \\t]*\\n(.*?)\\n[ \\t]*```', 1) AS code, 'mermaid_' || substr(md5(regexp_extract(text, '(?s)```mermaid[ \\t]*\\n(.*?)\\n[ \\t]*```', 1)), 1, 12) || '.png' AS name FROM m")
def diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.diagrams(markdown(spark, sf_dir)).select("doc_id", "block_no", "code", "name")


# ---- tables

ISLANDS = f"{LINES_SQL}, i AS (SELECT *, sum(CASE WHEN line LIKE '%|%' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM l)"
CELLS = r"list_transform(string_split(regexp_replace(" + STRIPPED + r", '^\|+|\|+$', '', 'g'), '|'), lambda c: " + STRIP.format("c") + ")"


@query(rf"""WITH {ISLANDS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, island ORDER BY line_no) AS row_no, {CELLS} AS cells FROM i WHERE line LIKE '%|%' AND NOT {SEP}),
w AS (SELECT *, count(*) OVER (PARTITION BY doc_id, island) AS n, max(len(cells)) OVER (PARTITION BY doc_id, island) AS width FROM r),
t AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY island) AS table_no FROM w WHERE n >= 2),
p AS (SELECT doc_id, table_no, 'Sheet' || table_no AS table_name, row_no, list_resize(cells, width, '') AS cells FROM t)
SELECT doc_id, table_no, table_name, row_no, generate_subscripts(cells, 1) - 1 AS col_no, unnest(cells) AS cell FROM p""")
def md_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.cells(tables.table_lines(lines.lines(table(spark, sf_dir, "documents"))))


@query(r"""SELECT n_regionkey AS key, '| n_name | n_nationkey |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || replace(n_name, '|', '\|') || ' | ' || n_nationkey || ' |', chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY 1""")
def md_table_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "nation").withColumn("key", F.col("n_regionkey"))
    return tables.rendered(x, ["key"], ["n_nationkey"], ["n_name", "n_nationkey"])


@query("""WITH r AS (SELECT s_nationkey AS doc_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) + 1 AS row_no, s_name, s_acctbal::VARCHAR AS bal FROM supplier)
SELECT doc_id, row_no, s_name AS name FROM r UNION ALL SELECT DISTINCT doc_id, 1, 's_name' FROM r""")
def md_table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = tables.rendered(table(spark, sf_dir, "supplier"), ["s_nationkey"], ["s_suppkey"], ["s_name", "s_acctbal"])
    back = tables.table_lines(lines.lines(made, "s_nationkey"), compat=False)
    return back.select("doc_id", "row_no", F.col("cells")[0].alias("name"))


@query(rf"""WITH {ISLANDS}, t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, island ORDER BY line_no) AS pos, count(*) OVER (PARTITION BY doc_id, island) AS n,
len(string_split(regexp_replace(regexp_replace(replace({STRIPPED}, '\|', chr(1)), '^\|', ''), '\|$', ''), '|')) AS width, {SEP} AS sep FROM i WHERE line LIKE '%|%'),
h AS (SELECT *, first_value(width) OVER (PARTITION BY doc_id, island ORDER BY line_no) AS header FROM t),
k AS (SELECT *, CASE WHEN n = 1 AND NOT sep THEN 'incomplete' WHEN pos = 2 AND NOT sep THEN 'separator' WHEN NOT sep AND width <> header THEN 'columns' END AS warning FROM h)
SELECT doc_id, line_no, warning, width, header FROM k WHERE warning IS NOT NULL""")
def table_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table_warnings(lines.lines(table(spark, sf_dir, "documents")))


RECORDS = "WITH j AS (SELECT event_id, props::JSON AS p FROM events WHERE props IS NOT NULL), k AS (SELECT event_id, unnest(json_keys(p)) AS key, generate_subscripts(json_keys(p), 1) AS pos FROM (SELECT event_id, props::JSON AS p FROM events WHERE props IS NOT NULL)), h AS (SELECT key, row_number() OVER (ORDER BY min(event_id), arg_min(pos, event_id)) - 1 AS col_no FROM k GROUP BY key)"


@query(RECORDS + " SELECT event_id, col_no::INT AS col_no, key, replace(coalesce(json_extract_string(p, '$.' || key), ''), '|', '\\|') AS cell FROM j CROSS JOIN h")
def json_to_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "events").where("props is not null").select("event_id", F.from_json("props", "map<string,string>").alias("rec"))
    out = tables.record_table(x, "event_id", "rec")
    return out.select("event_id", F.posexplode(F.arrays_zip(F.col("header").alias("key"), F.col("cells").alias("cell"))).alias("col_no", "x")).select("event_id", "col_no", "x.key", "x.cell")


CSV_SQL = r"""CASE WHEN regexp_matches(x, '^[-*] ') THEN '• ' || substr(x, 3) WHEN regexp_matches(x, '^[=+@-]') THEN '''' || x ELSE x END"""


@query(rf"""WITH c AS (SELECT p_partkey, {STRIP.format("regexp_replace(regexp_replace(cell, '\\*\\*(.+?)\\*\\*', '\\1', 'g'), '`(.+?)`', '\\1', 'g')")} AS x, col FROM
(SELECT p_partkey, '**' || p_name || '**' AS cell, 1 AS col FROM part UNION ALL SELECT p_partkey, '- ' || p_type, 2 FROM part UNION ALL SELECT p_partkey, '=' || p_size, 3 FROM part UNION ALL SELECT p_partkey, '`' || p_brand || '`', 4 FROM part))
SELECT p_partkey, col, {CSV_SQL} AS cell FROM c""")
def csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.array(F.concat(F.lit("**"), "p_name", F.lit("**")), F.concat(F.lit("- "), "p_type"), F.concat(F.lit("="), F.col("p_size").cast("string")), F.concat(F.lit("`"), "p_brand", F.lit("`")))
    x = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(made).alias("col", "cell"))
    return x.select("p_partkey", (F.col("col") + 1).alias("col"), T.csv_cell(F.col("cell")).alias("cell"))


@query(r"""SELECT p_partkey, regexp_replace('[' || p_brand || '] and ' || p_name || ' code', '[*_~`]', '', 'g') AS cell FROM part""")
def sheet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.concat(F.lit("![*"), "p_brand", F.lit("*](a.png) and [**"), "p_name", F.lit("**](http://x) `code`"))
    return table(spark, sf_dir, "part").select("p_partkey", T.flat_cell(x).alias("cell"))


@query(rf"""WITH {LINES_SQL}, k AS (SELECT *, {STRIPPED} AS s FROM l WHERE NOT ({STRIPPED} LIKE '%|%' AND {SEP})), g AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS row_no,
CASE WHEN s = '' THEN 0 WHEN s LIKE '%|%' THEN len(string_split(regexp_replace(s, '^\||\|$', '', 'g'), '|')) ELSE 1 END AS w FROM k)
SELECT doc_id, max(CASE WHEN w > 0 THEN row_no END) AS n_rows, max(w)::INT AS n_cols FROM g GROUP BY 1""")
def sheet_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.sheet_size(tables.grid(lines.lines(table(spark, sf_dir, "documents")), clean=False))


@query("""WITH a AS (SELECT l_orderkey AS doc_id, l_linenumber AS col_no, l_partkey % 700 AS x0, l_partkey % 700 + 20 + l_quantity AS x1 FROM lineitem),
b AS (SELECT l_orderkey AS doc_id, l_linenumber AS cell_no, l_suppkey * 7 % 700 AS x0, l_suppkey * 7 % 700 + 30 + l_quantity AS x1 FROM lineitem),
p AS (SELECT b.doc_id, cell_no, col_no, least(a.x1, b.x1) - greatest(a.x0, b.x0) AS overlap FROM a JOIN b ON a.doc_id = b.doc_id AND b.x0 < a.x1 AND a.x0 < b.x1)
SELECT doc_id, cell_no, col_no, overlap::DOUBLE AS overlap FROM p QUALIFY row_number() OVER (PARTITION BY doc_id, cell_no ORDER BY overlap DESC, col_no) = 1""")
def columns_by_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    up, low = F.col("l_partkey") % 700, F.col("l_suppkey") * 7 % 700
    above = x.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("col_no"), up.alias("x0"), (up + 20 + F.col("l_quantity")).alias("x1"))
    below = x.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("cell_no"), low.alias("x0"), (low + 30 + F.col("l_quantity")).alias("x1"))
    return tables.columns_by_overlap(above, below).withColumn("overlap", F.col("overlap").cast("double"))


ELEMENTS = "SELECT l_orderkey AS doc_id, (l_linenumber * 100000 + l_partkey) * 1000 + l_suppkey AS elem_no, CASE l_partkey % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'page_break' ELSE 'table' END AS type, l_suppkey % 200 AS n_chars, l_suppkey % 2 + 2 AS n_cols FROM lineitem"


@query(f"""WITH e AS ({ELEMENTS}), c AS (SELECT *, sum(CASE WHEN type = 'text' THEN n_chars ELSE 0 END) OVER w AS chars, sum((type = 'page_break')::INT) OVER w AS breaks FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY elem_no)),
g AS (SELECT *, coalesce(n_cols = lag(n_cols) OVER w AND breaks > lag(breaks) OVER w AND chars - lag(chars) OVER w < 150, false) AS goes_on FROM c WHERE type = 'table' WINDOW w AS (PARTITION BY doc_id ORDER BY elem_no))
SELECT doc_id, elem_no, sum((NOT goes_on)::INT) OVER (PARTITION BY doc_id ORDER BY elem_no) AS table_no, n_cols FROM g""")
def table_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_partkey") % 4 == 0, "text").when(F.col("l_partkey") % 4 == 1, "page_break").otherwise("table")
    x = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), ((F.col("l_linenumber") * 100000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey")).alias("elem_no"), kind.alias("type"), (F.col("l_suppkey") % 200).alias("n_chars"), (F.col("l_suppkey") % 2 + 2).alias("n_cols"))
    return tables.stitched(x)


# ---- text

@query(r"""SELECT event_id, CASE WHEN value IS NULL THEN 'null' WHEN regexp_matches(v, '^-?\d+$') THEN 'integer' WHEN regexp_matches(v, '^-?\d+\.\d+$') THEN 'float' WHEN lower(v) IN ('true', 'false') THEN 'boolean' WHEN lower(v) IN ('null', 'none', '~') THEN 'null' ELSE 'string' END AS kind,
CASE WHEN regexp_matches(v, '^-?\d+$') THEN regexp_replace(v, '^(-?)0+(\d)', '\1\2') WHEN lower(v) IN ('true', 'false') THEN lower(v) WHEN lower(v) IN ('null', 'none', '~') THEN NULL ELSE v END AS value
FROM (SELECT event_id, value, CASE event_id % 6 WHEN 0 THEN '00' || event_id WHEN 1 THEN event_id || '.50' WHEN 2 THEN 'TRUE' WHEN 3 THEN 'None' WHEN 4 THEN '1.2.' || event_id ELSE event_type END AS v FROM events)""")
def value_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id").cast("string")
    k = F.col("event_id") % 6
    v = F.when(k == 0, F.concat(F.lit("00"), i)).when(k == 1, F.concat(i, F.lit(".50"))).when(k == 2, "TRUE").when(k == 3, "None").when(k == 4, F.concat(F.lit("1.2."), i)).otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", T.coerced(v).alias("c")).select("event_id", "c.kind", "c.value")


@query("""WITH s AS (SELECT event_id, floor(value * 10)::BIGINT AS s FROM events WHERE value IS NOT NULL AND value >= 0)
SELECT event_id, CASE WHEN s // 3600 > 0 THEN CASE WHEN s // 3600 < 10 THEN '0' ELSE '' END || s // 3600 || ':' ELSE '' END || CASE WHEN s % 3600 // 60 < 10 THEN '0' ELSE '' END || s % 3600 // 60 || ':' || CASE WHEN s % 60 < 10 THEN '0' ELSE '' END || s % 60 AS stamp, s AS seconds FROM s""")
def timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "events").where("value >= 0").select("event_id", T.timestamp_text(F.col("value") * 10).alias("stamp"))
    return x.withColumn("seconds", T.timestamp_seconds(F.col("stamp")))


@query(r"""WITH u AS (SELECT page_id, 'https://www.youtube.com/watch?t=1&v=' || substr(md5(url), 1, 11) || '&x=2' AS a, 'https://youtu.be/' || substr(md5(url), 1, 11) AS b, 'https://drive.google.com/file/d/' || md5(url) || '/view' AS c FROM pages)
SELECT page_id, regexp_extract(a, 'v=([A-Za-z0-9_-]{11})', 1) AS watch, regexp_extract(b, 'youtu\.be/([A-Za-z0-9_-]{11})', 1) AS short, regexp_extract(c, '/file/d/([A-Za-z0-9_-]+)', 1) AS drive, 'video' AS kind FROM u""")
def url_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.md5(F.col("url").cast("binary"))
    watch = F.concat(F.lit("https://www.youtube.com/watch?t=1&v="), F.substring(h, 1, 11), F.lit("&x=2"))
    return table(spark, sf_dir, "pages").select("page_id", T.video_id(watch).alias("watch"), T.video_id(F.concat(F.lit("https://youtu.be/"), F.substring(h, 1, 11))).alias("short"), T.drive_id(F.concat(F.lit("https://drive.google.com/file/d/"), h, F.lit("/view"))).alias("drive"), T.link_kind(watch).alias("kind"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(url, '^yt://') THEN 'player' WHEN regexp_matches(url, '(?i)^[a-z][a-z0-9+.-]*://') THEN 'web' ELSE 'file' END AS kind FROM pages""")
def link_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.link_kind(F.col("url")).alias("kind"))


@query(r"""WITH f AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'con.txt' WHEN 1 THEN c_name || '?' WHEN 2 THEN '' WHEN 3 THEN ' ' || c_name WHEN 4 THEN repeat(c_name, 20) ELSE c_name || '.md' END AS name FROM customer)
SELECT c_custkey, CASE WHEN name = '' THEN 'empty' WHEN regexp_matches(name, '^\s|[\s.]$') THEN 'edge' WHEN length(name) > 255 THEN 'long' WHEN regexp_matches(name, '[<>:"/\\|?*]') THEN 'character' WHEN name = 'con.txt' THEN 'device' END AS problem FROM f""")
def filename_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey") % 6, F.col("c_name")
    name = F.when(k == 0, "con.txt").when(k == 1, F.concat(n, F.lit("?"))).when(k == 2, "").when(k == 3, F.concat(F.lit(" "), n)).when(k == 4, F.repeat(n, 20)).otherwise(F.concat(n, F.lit(".md")))
    return table(spark, sf_dir, "customer").select("c_custkey", T.filename_problem(name).alias("problem"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN '**' ELSE '' END AS open, '  ' || CASE WHEN l_linenumber % 2 = 0 THEN '**' ELSE '' END || l_shipdate || CASE WHEN l_linenumber % 2 = 0 THEN '**' ELSE '' END || ' ' AS styled,
round_even(800 * 0.5, 0)::INT AS w, round_even(l_partkey * 0.5, 0)::INT AS h FROM lineitem""")
def styled_and_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    bold, no = F.col("l_linenumber") % 2 == 0, F.lit(False)
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(bold, "**").otherwise("").alias("open"), T.wrap_style(F.concat(F.lit("  "), F.col("l_shipdate").cast("string"), F.lit(" ")), bold, no, no, no, no).alias("styled"), T.scaled(F.lit(800), F.col("l_partkey"), F.lit("50%")).alias("size"))
    return x.select("l_orderkey", "l_linenumber", "open", "styled", "size.w", "size.h")


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\s\x0b]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(w) AS n, round(len(list_filter(w, lambda x: length(x) <= 2)) / greatest(len(w), 1), 9) AS short, round(list_sum(list_transform(w, lambda x: length(x))) / greatest(len(w), 1), 9) AS mean FROM w""")
def word_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.word_shape(F.col("text")).alias("s"))
    return x.select("doc_id", "s.n", F.round("s.short", 9).alias("short"), F.round("s.mean", 9).alias("mean"))


@query()
def inline_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = lines.lines(table(spark, sf_dir, "documents"))
    return x.select("doc_id", "line_no", F.posexplode(segments(F.col("line"))).alias("seg_no", "s")).select("doc_id", "line_no", "seg_no", "s.*")


#: Marks around a part's name, and the segments that they must give: text before, style, address, picture.
STYLED = [("**{}**", "bold", None), ("*{}*", "italic", None), ("~~{}~~", "strike", None), ("<U>{}</u>", "underline", None), ("`{}`", "code", None), ("[{}](http://x/y)", None, "http://x/y"), ("![{}](pic (1).png)", None, "pic (1).png")]


@query("WITH v AS (SELECT p_partkey, p_name, k, style, url FROM part CROSS JOIN (VALUES " + ", ".join(f"({k}, {f"'{s}'" if s else 'NULL'}, {f"'{u}'" if u else 'NULL'})" for k, (_, s, u) in enumerate(STYLED)) + """) AS v(k, style, url)), s AS (SELECT p_partkey, k, 0 AS seg_no, 'a ' AS text, NULL AS style, NULL AS url, false AS is_image FROM v UNION ALL SELECT p_partkey, k, 1, p_name, style, url, k = 6 FROM v UNION ALL SELECT p_partkey, k, 2, ' z', NULL, NULL, false FROM v)
SELECT p_partkey, k, seg_no, text, coalesce(style = 'bold', false) AS bold, coalesce(style = 'italic', false) AS italic, coalesce(style = 'strike', false) AS strike, coalesce(style = 'underline', false) AS underline, coalesce(style = 'code', false) AS code, url, is_image FROM s""")
def styled_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.array(*(F.concat(F.lit("a " + m.split("{}")[0]), F.col("p_name"), F.lit(m.split("{}")[1] + " z")) for m, _, _ in STYLED))
    x = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name")).select("p_partkey", F.posexplode(made).alias("k", "line"))
    return x.select("p_partkey", "k", F.posexplode(segments(F.col("line"))).alias("seg_no", "s")).select("p_partkey", "k", "seg_no", "s.*")


@query(r"""SELECT p_partkey, p_name || ' and ' || p_brand || ' in ' || p_type AS text FROM part""")
def inline_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.concat(F.lit("**"), "p_name", F.lit("** and [*"), "p_brand", F.lit("*](http://x) in `"), "p_type", F.lit("`"))
    return table(spark, sf_dir, "part").select("p_partkey", stripped(x).alias("text"))


@query("WITH k AS (SELECT event_id, props::JSON AS p, unnest(json_keys(props::JSON)) AS key FROM events WHERE props IS NOT NULL) SELECT event_id, key, json_extract_string(p, '$.' || key) AS value FROM k")
def tree_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties over Markdown and back, key by key."""
    again = markdown_to_json(json_to_markdown(F.col("props")))
    x = table(spark, sf_dir, "events").where("props is not null").select("event_id", F.from_json(again, "map<string,string>").alias("again"))
    return x.select("event_id", F.explode("again").alias("key", "value"))


@query("WITH k AS (SELECT event_id, props::JSON AS p, unnest(json_keys(props::JSON)) AS key, generate_subscripts(json_keys(props::JSON), 1) AS pos FROM events WHERE props IS NOT NULL), t AS (SELECT event_id, string_agg('- **' || key || '**: ' || json_extract_string(p, '$.' || key), chr(10) ORDER BY pos) AS text FROM k GROUP BY 1) SELECT event_id, text FROM events LEFT JOIN t USING (event_id)")
def tree_to_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", json_to_markdown(F.col("props")).alias("text"))


@query()
def html_to_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html_to_markdown(F.col("html")).alias("text"))


@query(r"""SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1) AS title, len(regexp_extract_all(html, '(?i)<a\b')) AS n_links, len(regexp_extract_all(html, '(?i)<p\b')) AS n_paragraphs FROM pages""")
def html_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda p: F.regexp_count("html", F.lit(p))
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title", 1).alias("title"), count(r"(?i)<a\b").alias("n_links"), count(r"(?i)<p\b").alias("n_paragraphs"))


# ---- images and links

@query(f"WITH {MARKDOWN_SQL} SELECT doc_id, 0 AS token_no, strpos(text, '![') - 1 AS start, strpos(text, '![') - 1 + length('![map](maps/' || doc_id || '.png)') AS \"end\", 'maps/' || doc_id || '.png' AS src, 'map' AS alt FROM m")
def image_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.image_tokens(markdown(spark, sf_dir)).select("doc_id", "token_no", "start", "end", "src", "alt")


@query(f"WITH {MARKDOWN_SQL} SELECT doc_id, replace(text, 'maps/' || doc_id || '.png', 'assets/' || md5('maps/' || doc_id || '.png') || '.png') AS text FROM m")
def image_relink(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = markdown(spark, sf_dir)
    found = images.image_tokens(docs)
    return images.relinked(docs, found, found.select("src", F.concat(F.lit("assets/"), F.md5(F.col("src").cast("binary")), F.lit(".png")).alias("path")).distinct())


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '![' || p_name || '](a/' || p_partkey || '.png)' WHEN p_size % 3 = 1 THEN '<img src=\"a/' || p_partkey || '.png\" alt=\"' || p_name || '\" width=\"25%\">' ELSE '<p align=\"center\"><img src=\"a/' || p_partkey || '.png\" alt=\"' || p_name || '\"></p>' END AS markup FROM part")
def image_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 3
    src = F.concat(F.lit("a/"), F.col("p_partkey").cast("string"), F.lit(".png"))
    return table(spark, sf_dir, "part").select("p_partkey", T.image_markup(src, F.col("p_name"), F.when(k == 1, "25%").otherwise(""), F.when(k == 2, "center").otherwise("")).alias("markup"))


# ---- search

@query(f"""WITH {LINES_SQL}, o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l),
h AS (SELECT *, unnest(list_filter(generate_series(1, length(line) - 3), lambda i: substr(line, i, 4) = 'tion')) AS i FROM o)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start, i) AS hit_no, (start + i - 1)::BIGINT AS start, (start + i + 3)::BIGINT AS "end", line_no, substr(trim(line), 1, 60) AS snippet FROM h""")
def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hits(table(spark, sf_dir, "documents"), "tion")


@query("SELECT doc_id, md5(replace(text, 'tion', '$1\\x')) AS digest FROM documents")
def replace_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = search.replaced(table(spark, sf_dir, "documents"), "tion", "$1\\x")
    return x.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT c_custkey, 'customers/' || c_mktsegment || '/' || c_name AS path FROM customer WHERE lower(c_name) LIKE '%77%' OR lower('customers/' || c_mktsegment || '/' || c_name) LIKE '%77%'")
def quick_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.concat(F.lit("customers/"), "c_mktsegment", F.lit("/"), "c_name").alias("path"))
    return catalog.found(x, "77").select("c_custkey", "path")


@query("""WITH p AS (SELECT n_nationkey AS id, n_name || ' is ' || n_regionkey AS a, n_name || ' was ' || n_regionkey AS b FROM nation) SELECT id, length(split_part(a, ' is ', 1)) + 1 AS prefix, length(a) - length(split_part(a, ' is ', 1)) - 2 AS suffix FROM p""")
def changed_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.concat("n_name", F.lit(" is "), F.col("n_regionkey").cast("string")).alias("before"), F.concat("n_name", F.lit(" was "), F.col("n_regionkey").cast("string")).alias("after"))
    return search.changed_range(x).select("id", "prefix", "suffix")


# ---- transcripts

SNIPPETS = "SELECT user_id AS media_id, event_id AS seq, (epoch(ts) - min(epoch(ts)) OVER ()) / 600 AS start, event_type || CASE WHEN event_id % 3 = 0 THEN '.' ELSE '' END AS text FROM events"


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "events")
    first = x.agg(F.min("ts").alias("first"))
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("first").cast("timestamp"))) / 1e6 / 600
    return x.join(F.broadcast(first)).select(F.col("user_id").alias("media_id"), F.col("event_id").alias("seq"), seconds.alias("start"), F.concat("event_type", F.when(F.col("event_id") % 3 == 0, ".").otherwise("")).alias("text"))


@query(f"WITH s AS ({SNIPPETS}), g AS (SELECT *, coalesce(start - lag(start) OVER (PARTITION BY media_id ORDER BY start, seq) >= 20, true) AS n FROM s) SELECT media_id, seq, sum(n::INT) OVER (PARTITION BY media_id ORDER BY start, seq) AS session_no FROM g")
def pause_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.pauses(snippets(spark, sf_dir), 20.0).select("media_id", "seq", "session_no")


@query(f"WITH s AS ({SNIPPETS}), g AS (SELECT *, lag(text) OVER (PARTITION BY media_id ORDER BY start, seq) AS last FROM s) SELECT media_id, seq, text FROM g WHERE last IS NULL OR text <> last")
def asr_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.without_repeats(snippets(spark, sf_dir)).select("media_id", "seq", "text")


@query()
def transcript_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.sentence_groups(snippets(spark, sf_dir), pause=20.0)


@query()
def transcript_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = transcript.sentence_groups(snippets(spark, sf_dir), pause=20.0)
    titles = table(spark, sf_dir, "events").select(F.col("user_id").alias("media_id")).distinct().select("media_id", F.concat(F.lit("Talk "), F.col("media_id").cast("string")).alias("title"), F.when(F.col("media_id") % 2 == 0, F.substring(F.md5(F.col("media_id").cast("string").cast("binary")), 1, 11)).alias("video"))
    return transcript.transcript(groups, titles)


# ---- pages

@query("""WITH t AS (SELECT l_suppkey % 40 AS page, l_orderkey % 5 AS block, l_linenumber AS par, l_partkey % 20 AS line, l_orderkey * 8 + l_linenumber AS word, l_linestatus || l_suppkey AS text, l_quantity::INT AS conf FROM lineitem),
k AS (SELECT * FROM t WHERE conf >= 15 OR length(text) > 2), g AS (SELECT page, block, par, line, string_agg(text, ' ' ORDER BY word, text) AS text FROM k GROUP BY 1, 2, 3, 4)
SELECT page, block, par, line, md5(text) AS digest, coalesce(block <> lag(block) OVER w OR par <> lag(par) OVER w, false) AS gap FROM g WINDOW w AS (PARTITION BY page ORDER BY block, par, line)""")
def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 40).alias("page"), (F.col("l_orderkey") % 5).alias("block"), F.col("l_linenumber").alias("par"), (F.col("l_partkey") % 20).alias("line"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("word"), F.concat("l_linestatus", F.col("l_suppkey").cast("string")).alias("text"), F.col("l_quantity").cast("int").alias("conf"))
    return layout.ocr_lines(layout.confident(x)).select("page", "block", "par", "line", F.md5(F.col("text").cast("binary")).alias("digest"), "gap")


@query("""WITH w AS (SELECT l_orderkey AS line_id, l_partkey % 500 AS x0, l_partkey % 500 + 12 AS x1, l_linenumber FROM lineitem), g AS (SELECT *, coalesce((x0 - lag(x1) OVER (PARTITION BY line_id ORDER BY x0, x1) >= 20)::INT, 0) AS n FROM w)
SELECT line_id, max(s) AS n_segments FROM (SELECT line_id, sum(n) OVER (PARTITION BY line_id ORDER BY x0, x1) + 1 AS s FROM g) GROUP BY 1""")
def line_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("line_id"), (F.col("l_partkey") % 500).alias("x0"), (F.col("l_partkey") % 500 + 12).alias("x1"))
    return layout.segments(x).groupBy("line_id").agg(F.max("segment_no").alias("n_segments"))


@query("""WITH i AS (SELECT l_orderkey AS doc_id, (l_linenumber * 100000 + l_partkey) * 1000 + l_suppkey AS seq, (l_partkey % 3 + 1)::INT AS level, l_suppkey % 4 > 0 AS numbered FROM lineitem),
c AS (SELECT a.*, (SELECT coalesce(max(b.seq), 0) FROM i b WHERE b.doc_id = a.doc_id AND b.seq <= a.seq AND (b.level < a.level OR b.level = a.level AND NOT b.numbered)) AS cut FROM i a)
SELECT doc_id, seq, level, CASE WHEN numbered THEN (SELECT count(*) FROM i b WHERE b.doc_id = c.doc_id AND b.level = c.level AND b.numbered AND b.seq > c.cut AND b.seq <= c.seq) END AS number FROM c""")
def item_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), ((F.col("l_linenumber") * 100000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey")).alias("seq"), (F.col("l_partkey") % 3 + 1).cast("int").alias("level"), (F.col("l_suppkey") % 4 > 0).alias("numbered"))
    return layout.item_numbers(x).select("doc_id", "seq", "level", "number")


@query()
def clause_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), (F.col("l_partkey") % 5).alias("article"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), F.when(F.col("l_partkey") % 7 > 0, F.col("l_quantity").cast("int")).alias("number"))
    return layout.clause_numbers(x)


LEGAL = "SELECT o_custkey AS doc_id, o_orderkey AS seq, CASE o_orderkey % 6 WHEN 0 THEN 'Chương Ï' WHEN 1 THEN o_orderpriority WHEN 2 THEN 'Điều ' || (o_custkey % 9 + 1) || '. ' || o_orderpriority WHEN 3 THEN '1. ' || o_orderpriority WHEN 4 THEN 'a) ' || o_orderpriority ELSE 'Mục ' || (o_custkey % 9 + 1) END AS line FROM orders"


@query(r"""WITH l AS (""" + LEGAL + r"""), k AS (SELECT *, CASE WHEN line LIKE 'Chương %' THEN 'chapter' WHEN regexp_matches(line, '^Mục \d+') THEN 'section' WHEN regexp_matches(line, '^Điều \d+\.') THEN 'article' WHEN regexp_matches(line, '^\d+\. ') THEN 'clause' WHEN regexp_matches(line, '^a\) ') THEN 'point' ELSE 'text' END AS kind FROM l),
t AS (SELECT *, lag(kind) OVER w AS before, lead(kind) OVER w AS after_kind, lead(line) OVER w AS after FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY seq))
SELECT doc_id, seq, kind, CASE kind WHEN 'chapter' THEN '# Chương I' || CASE WHEN after_kind = 'text' THEN ': ' || after ELSE '' END WHEN 'section' THEN '## ' || line WHEN 'article' THEN '### ' || line WHEN 'point' THEN '- ' || line ELSE line END AS markdown FROM t WHERE NOT (kind = 'text' AND coalesce(before, '') = 'chapter')""")
def legal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("o_orderkey") % 6, (F.col("o_custkey") % 9 + 1).cast("string")
    line = F.when(k == 0, "Chương Ï").when(k == 1, F.col("o_orderpriority")).when(k == 2, F.concat(F.lit("Điều "), n, F.lit(". "), "o_orderpriority")).when(k == 3, F.concat(F.lit("1. "), "o_orderpriority")).when(k == 4, F.concat(F.lit("a) "), "o_orderpriority")).otherwise(F.concat(F.lit("Mục "), n))
    return layout.legal_lines(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("seq"), line.alias("line")))


@query(r"""WITH l AS (SELECT *, trim(line) AS s FROM (SELECT doc_id, line_no // 3 AS page_no, line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL)) WHERE regexp_replace(line, '[\s\x0b]', '', 'g') <> ''),
k AS (SELECT * FROM l WHERE NOT regexp_matches(s, '^[-–]?\s*\d{1,4}\s*[-–]?$')), b AS (SELECT *, lag(s) OVER w AS before, lag(page_no) OVER w AS page FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY page_no, line_no))
SELECT doc_id, line_no, coalesce(page <> page_no AND NOT regexp_matches(before, '[.;:!?]$') AND (regexp_matches(before, ',$') OR regexp_matches(s, '^\p{Ll}')), false) AS joins FROM b""")
def pages_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = lines.lines(table(spark, sf_dir, "documents")).withColumn("page_no", F.floor(F.col("line_no") / 3))
    return layout.pages_joined(x).select("doc_id", "line_no", "joins")


# ---- files and workspaces

PATHS = "SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'Node_Modules/' WHEN 1 THEN '.git/' WHEN 2 THEN 'docs/' WHEN 3 THEN 'build/' WHEN 4 THEN 'dist/bin/' WHEN 5 THEN '$RECYCLE.BIN/' WHEN 6 THEN 'System Volume Information/' ELSE 'Data/' END || c_name || CASE c_nationkey % 4 WHEN 0 THEN '.CSV' WHEN 1 THEN '.docx' WHEN 2 THEN '.exe' ELSE '.md' END AS path FROM customer"


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey") % 8, F.col("c_nationkey") % 4
    folder = F.element_at(F.array(*map(F.lit, ["Node_Modules/", ".git/", "docs/", "build/", "dist/bin/", "$RECYCLE.BIN/", "System Volume Information/", "Data/"])), (k + 1).cast("int"))
    ext = F.when(n == 0, ".CSV").when(n == 1, ".docx").when(n == 2, ".exe").otherwise(".md")
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(folder, "c_name", ext).alias("path"))


@query(f"WITH p AS ({PATHS}) SELECT c_custkey, path, CASE lower(right(path, 4)) WHEN '.csv' THEN 'CSV' WHEN 'docx' THEN 'Word' ELSE 'Markdown' END AS format FROM p WHERE c_custkey % 8 IN (2, 3, 4, 7) AND path NOT LIKE '%.exe'")
def scan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.readable(paths(spark, sf_dir), catalog.registry(spark)).select("c_custkey", "path", "format")


@query(f"WITH p AS ({PATHS}), e AS (SELECT split_part(path, '/', 1) AS folder, split_part(path, '/', 2) AS name, c_custkey % 3 = 0 AS is_dir FROM p) SELECT folder, name, is_dir, row_number() OVER (PARTITION BY folder ORDER BY is_dir DESC, lower(name), name) AS place FROM e")
def folder_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = paths(spark, sf_dir).select(F.split_part("path", F.lit("/"), F.lit(1)).alias("folder"), F.split_part("path", F.lit("/"), F.lit(2)).alias("name"), (F.col("c_custkey") % 3 == 0).alias("is_dir"))
    return catalog.listing(x)


@query("""WITH f AS (SELECT l_orderkey * 8 + l_linenumber AS scan_no, 'in/' || l_partkey || CASE l_suppkey % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.csv' ELSE '.docx' END AS path, CASE l_suppkey % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.csv' ELSE '.docx' END AS ext, 'in/' || l_partkey AS base FROM lineitem),
k AS (SELECT *, count(*) OVER (PARTITION BY base) > 1 AS shared, row_number() OVER (PARTITION BY base, ext ORDER BY scan_no) - CASE WHEN ext = '.md' THEN 2 ELSE 1 END AS k FROM f)
SELECT scan_no, path, base || CASE WHEN NOT shared OR k < 0 THEN '' WHEN k = 0 THEN ' (' || substr(ext, 2) || ')' ELSE ' (' || substr(ext, 2) || '_' || k || ')' END || '.md' AS output FROM k""")
def batch_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_suppkey") % 3
    x = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("scan_no"), F.concat(F.lit("in/"), F.col("l_partkey").cast("string"), F.when(k == 0, ".md").when(k == 1, ".csv").otherwise(".docx")).alias("path"))
    return catalog.destinations(x, ".md")


@query("""SELECT o_orderpriority, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS succeeded, count(*) FILTER (WHERE o_orderstatus = 'O') AS failed, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS skipped, round(sum(o_totalprice::DOUBLE), 2) AS duration FROM orders GROUP BY 1""")
def batch_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "failed").otherwise("skipped")
    x = table(spark, sf_dir, "orders").select("o_orderpriority", status.alias("status"), F.col("o_totalprice").cast("double").alias("duration"))
    return catalog.rollup(x, ["o_orderpriority"]).withColumn("duration", F.round("duration", 2))


@query("""WITH e AS (SELECT user_id AS owner, event_type || event_id % 9 AS item, epoch_us(ts) AS "at", CASE WHEN event_id % 2 = 0 THEN 'view' ELSE '' END AS mode, event_id % 11 = 0 AS pinned FROM events),
o AS (SELECT owner, item, max("at") AS "at", bool_or(pinned) AS pinned, max_by(mode, "at") FILTER (WHERE mode <> '') AS mode FROM e GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY pinned DESC, "at" DESC, item) AS place FROM o) WHERE place <= 20""")
def recent_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), F.concat("event_type", (F.col("event_id") % 9).cast("string")).alias("item"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.when(F.col("event_id") % 2 == 0, "view").otherwise("").alias("mode"), (F.col("event_id") % 11 == 0).alias("pinned"))
    return catalog.recent(x)


@query("""WITH s AS (SELECT source AS store, doc_id AS session, (doc_id * 7919) % 100003 AS mtime, n_chars AS size, doc_id % 5 = 0 AS protected FROM documents), t AS (SELECT *, sum(size) OVER (PARTITION BY store) AS total FROM s),
g AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY store ORDER BY mtime, session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS gone_before FROM t WHERE NOT protected)
SELECT store, session, mtime, size, gone_before FROM g WHERE total - gone_before > 50000""")
def cache_evictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "documents").select(F.col("source").alias("store"), F.col("doc_id").alias("session"), (F.col("doc_id") * 7919 % 100003).alias("mtime"), F.col("n_chars").alias("size"), (F.col("doc_id") % 5 == 0).alias("protected"))
    return catalog.evicted(x, 50_000)


@query("""SELECT doc_id, lang, md5(text) AS digest, min(doc_id) OVER (PARTITION BY lang, md5(text)) AS first, doc_id <> min(doc_id) OVER (PARTITION BY lang, md5(text)) AS is_copy FROM documents WHERE text IS NOT NULL""")
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "lang", F.col("text").alias("content"))
    return catalog.first_copies(x, "lang", "doc_id").select("doc_id", "lang", "digest", "first", "is_copy")


@query(f"WITH p AS ({PATHS}) SELECT c_custkey, CASE WHEN path LIKE 'docs/%' THEN 'papers/old' || substr(path, 5) ELSE path END AS path FROM p")
def rename_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.renamed(paths(spark, sf_dir), "docs", "papers/old")


@query(f"WITH p AS ({PATHS}) SELECT c_custkey, CASE WHEN path LIKE 'docs/%' THEN NULL ELSE path END AS path, c_custkey % 2 = 0 AS dirty FROM p WHERE path NOT LIKE 'docs/%' OR c_custkey % 2 = 0")
def delete_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.deleted(paths(spark, sf_dir).withColumn("dirty", F.col("c_custkey") % 2 == 0), "docs")


@query(f"""WITH p AS ({PATHS}), m AS (SELECT c_custkey, path, CASE c_custkey % 4 WHEN 0 THEN path WHEN 1 THEN split_part(path, '/', 1) WHEN 2 THEN path || '/sub' ELSE 'elsewhere' END AS folder FROM p)
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'same' WHEN 1 THEN 'already there' WHEN 2 THEN 'circular' END AS problem FROM m""")
def move_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    folder = F.when(k == 0, F.col("path")).when(k == 1, F.split_part("path", F.lit("/"), F.lit(1))).when(k == 2, F.concat("path", F.lit("/sub"))).otherwise("elsewhere")
    return paths(spark, sf_dir).select("c_custkey", catalog.move_problem(F.col("path"), folder).alias("problem"))


@query("""WITH m AS (SELECT p_partkey, 'd/' || p_brand || '/' || p_partkey AS source, CASE p_partkey % 6 WHEN 0 THEN 'd/' || p_brand || '/' || p_partkey WHEN 1 THEN 'd/' || p_brand WHEN 2 THEN 'nowhere' WHEN 3 THEN 'd/' || p_brand || '/' || p_partkey || '/sub' WHEN 4 THEN 'full' ELSE 'empty' END AS folder FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 10 = 7 THEN 'missing' ELSE CASE p_partkey % 6 WHEN 0 THEN 'same' WHEN 1 THEN 'already there' WHEN 2 THEN 'folder' WHEN 3 THEN 'circular' WHEN 4 THEN 'collision' END END AS problem FROM m""")
def moves_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    home, name = F.concat(F.lit("d/"), F.col("p_brand")), k.cast("string")
    source = F.concat(home, F.lit("/"), name)
    folder = F.when(k % 6 == 0, source).when(k % 6 == 1, home).when(k % 6 == 2, "nowhere").when(k % 6 == 3, F.concat(source, F.lit("/sub"))).when(k % 6 == 4, "full").otherwise("empty")
    here = part.where(k % 10 != 7)
    held = here.select(source.alias("path"), F.lit(True).alias("is_dir")).union(part.select(home, F.lit(True))).union(part.select(F.concat(source, F.lit("/sub")), F.lit(True))).union(part.select(F.explode(F.array(F.lit("full"), F.lit("empty"))), F.lit(True))).union(part.select(F.concat(F.lit("full/"), name), F.lit(False)))
    return catalog.moves_checked(part.select("p_partkey", source.alias("source"), folder.alias("folder")), held.distinct()).select("p_partkey", "problem")


@query("""WITH f AS (SELECT o_orderkey AS scan_no, o_orderpriority || CASE WHEN o_custkey % 50 = 0 THEN '_' || o_custkey % 40 + 1 ELSE '' END || '.pdf' AS name FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY scan_no) - 1 AS n FROM f), t AS (SELECT DISTINCT name AS taken FROM f),
g AS (SELECT name AS stem, k, row_number() OVER (PARTITION BY name ORDER BY k) AS free FROM (SELECT DISTINCT name FROM f) CROSS JOIN range(1, (SELECT count(*) + 100 FROM orders)::BIGINT) r(k) WHERE k <= (SELECT max(n) + 100 FROM n) AND regexp_replace(name, '\\.pdf$', '_' || k || '.pdf') NOT IN (SELECT taken FROM t))
SELECT scan_no, name, CASE WHEN n = 0 THEN name ELSE regexp_replace(name, '\\.pdf$', '_' || k || '.pdf') END AS "unique" FROM n LEFT JOIN g ON stem = name AND free = n""")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.when(F.col("o_custkey") % 50 == 0, F.concat(F.lit("_"), (F.col("o_custkey") % 40 + 1).cast("string"))).otherwise("")
    return catalog.unique_names(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scan_no"), F.concat("o_orderpriority", tail, F.lit(".pdf")).alias("name")))


@query("""WITH r AS (SELECT p_brand AS model, p_partkey AS file, md5(p_name) AS sha FROM part), a AS (SELECT p_brand AS model, p_partkey AS file, p_size - 1 AS size, md5(p_name) AS sha FROM part WHERE p_partkey % 97 > 0 OR p_brand < 'Brand#3')
SELECT r.model, bool_and(coalesce(size > 0 AND a.sha = r.sha, false)) AS installed, count(*) AS n_files FROM r LEFT JOIN a USING (model, file) GROUP BY 1""")
def installed_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "part").select(F.col("p_brand").alias("model"), F.col("p_partkey").alias("file"), F.md5(F.col("p_name").cast("binary")).alias("sha256"), (F.col("p_size") - 1).alias("size"))
    return catalog.installed(x.drop("size"), x.where((F.col("file") % 97 > 0) | (F.col("model") < "Brand#3")))


@query("""WITH m AS (SELECT s_suppkey, s_suppkey % 23 / 2.0 + 2 AS ram, s_suppkey % 7 AS free, s_suppkey % 12 AS cores, s_nationkey % 3 = 0 AS cuda, s_suppkey % 17 * 512.0 AS total, s_suppkey % 11 * 600.0 AS vram FROM supplier)
SELECT s_suppkey, CASE WHEN cuda AND (vram >= 5500 OR total * 0.7 >= 5500) THEN 'whisper-large-v3' WHEN cuda AND (vram >= 3000 OR total * 0.7 >= 3000) THEN 'whisper-medium' WHEN cuda AND (vram >= 1500 OR total * 0.7 >= 1500) THEN 'whisper-small'
WHEN NOT cuda AND ram >= 6.5 AND cores >= 4 AND free >= 2 AND ram <> 6.5 THEN 'whisper-small' ELSE 'whisper-base' END AS model, CASE WHEN cuda AND vram >= 1000 THEN 'cuda' ELSE 'cpu' END AS device, CASE WHEN cuda AND vram >= 1000 THEN 'float16' ELSE 'int8' END AS "precision" FROM m""")
def recommended_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    x = table(spark, sf_dir, "supplier").select("s_suppkey", (k % 23 / 2.0 + 2).alias("ram_total_gb"), (k % 7).alias("ram_free_gb"), (k % 12).alias("cores"), (F.col("s_nationkey") % 3 == 0).alias("cuda"), (k % 17 * 512.0).alias("vram_total_mb"), (k % 11 * 600.0).alias("vram_free_mb"))
    return catalog.recommended(x).select("s_suppkey", "model", "device", "precision")


@query("""WITH s AS (SELECT n_name AS key, CASE WHEN n_nationkey % 2 = 0 THEN 'vi' ELSE 'en' END AS locale, lower(n_name) AS text FROM nation), k AS (SELECT n_name AS key FROM nation UNION ALL SELECT r_name FROM region)
SELECT k.key, coalesce(v.text, e.text, k.key) AS text FROM k LEFT JOIN s v ON v.key = k.key AND v.locale = 'vi' LEFT JOIN s e ON e.key = k.key AND e.locale = 'en'""")
def localised_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    strings = n.select(F.col("n_name").alias("key"), F.when(F.col("n_nationkey") % 2 == 0, "vi").otherwise("en").alias("locale"), F.lower("n_name").alias("text"))
    keys = strings.select("key").unionAll(table(spark, sf_dir, "region").select("r_name"))
    return catalog.localised(keys, strings, "vi")


@query("""WITH e AS (SELECT user_id AS job_id, epoch_us(ts) AS "at", event_type AS status, value AS progress FROM events) SELECT job_id, max_by(status, ("at", status)) AS status, max(progress) AS progress, min("at") AS created_at, false AS ended FROM e GROUP BY 1""")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_type").alias("status"), F.col("value").alias("progress"))
    return catalog.jobs_state(x)


@query("WITH r AS (SELECT l_orderkey AS doc_id, l_linenumber AS line, l_suppkey % 3 AS generation FROM lineitem) SELECT * FROM r WHERE (doc_id, generation) IN (SELECT doc_id, max(generation) FROM r GROUP BY 1)")
def latest_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.latest_generation(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line"), (F.col("l_suppkey") % 3).alias("generation")))


@query("""WITH e AS (SELECT l_linenumber, ['FileNotFoundError', 'IsADirectoryError', 'PermissionError', 'ModuleNotFoundError', 'BadZipFile', 'UnicodeDecodeError', 'ValueError', 'KeyError', 'ImportError'][l_suppkey % 9 + 1] AS x, CASE l_linestatus WHEN 'F' THEN 'write' ELSE 'read' END AS stage FROM lineitem)
SELECT l_linenumber, CASE x WHEN 'FileNotFoundError' THEN 'FILE_NOT_FOUND' WHEN 'IsADirectoryError' THEN 'IS_DIRECTORY' WHEN 'PermissionError' THEN CASE stage WHEN 'write' THEN 'READ_ONLY_SAVE_ERROR' ELSE 'FILE_LOCKED' END WHEN 'ModuleNotFoundError' THEN 'MISSING_DEPENDENCY' WHEN 'ImportError' THEN 'MISSING_DEPENDENCY'
WHEN 'BadZipFile' THEN 'CORRUPTED_STRUCTURE' WHEN 'UnicodeDecodeError' THEN 'CORRUPTED_STRUCTURE' WHEN 'ValueError' THEN 'CONVERSION_FAILED' ELSE 'UNKNOWN_ERROR' END AS code, count(*) AS n FROM e GROUP BY ALL""")
def error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ["FileNotFoundError", "IsADirectoryError", "PermissionError", "ModuleNotFoundError", "BadZipFile", "UnicodeDecodeError", "ValueError", "KeyError", "ImportError"]))
    x = table(spark, sf_dir, "lineitem").select("l_linenumber", F.element_at(kinds, (F.col("l_suppkey") % 9 + 1).cast("int")).alias("exception"), F.when(F.col("l_linestatus") == "F", "write").otherwise("read").alias("stage"))
    return catalog.error_codes(x).groupBy("l_linenumber", "code").agg(F.count("*").alias("n"))


# ---- files of each format, as bytes made of the tables


FILES = """f AS (SELECT c_custkey AS k, c_name AS n, chr(10) AS e, ['.csv', '.json', '.yaml', '.html', '.md'][c_custkey % 5 + 1] AS ext FROM customer)"""


def customer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each customer in one of five formats, some of them broken."""
    c, k = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name")), F.col("c_custkey")
    key, name = k.cast("string"), F.col("c_name")
    text = (
        F.when(k % 5 == 0, F.concat(F.lit('name,key\n"'), name, F.lit(', the"\n'), key, F.lit(",1,2\n")))
        .when(k % 5 == 1, F.to_json(F.struct(name.alias("title"), F.struct(k.alias("key")).alias("settings"), F.array(F.struct(name.alias("a"))).alias("rows"))))
        .when(k % 5 == 2, F.concat(F.lit("server:\n  port: 80"), key, F.lit("\n  host: "), name))
        .when(k % 5 == 3, F.concat(F.lit("<h1>"), name, F.lit("</h1><ul><li>one<li>"), key, F.lit("</ul>")))
        .otherwise(F.concat(F.lit("# "), name, F.lit("\n\n| a | b |\n| --- | --- |\n| "), key, F.lit(" | x |\n")))
    )
    ext = F.element_at(F.array(*map(F.lit, [".csv", ".json", ".yaml", ".html", ".md"])), (k % 5 + 1).cast("int"))
    content = F.when(k % 50 == 6, F.lit("{broken")).otherwise(text).cast("binary")
    return c.select(F.concat(F.lit("in/"), name, F.when(k % 50 == 9, ".exe").otherwise(ext)).alias("path"), F.octet_length(content).cast("long").alias("length"), content.alias("content"))


@query(f"""WITH {FILES} SELECT 'in/' || n || CASE WHEN k % 50 = 9 THEN '.exe' ELSE ext END AS path, CASE WHEN k % 50 = 6 THEN 'JSONDecodeError: Expecting property name enclosed in double quotes: line 1 column 2 (char 1)' WHEN k % 50 = 9 THEN 'no reader for .exe' END AS error,
CASE WHEN k % 50 IN (6, 9) THEN NULL ELSE CASE k % 5 WHEN 0 THEN '| name | key |  |' || e || '| --- | --- | --- |' || e || '| ' || n || ', the |  |  |' || e || '| ' || k || ' | 1 | 2 |' WHEN 1 THEN '- **title**: ' || n || e || e || '# settings' || e || e || '- **key**: ' || k || e || e || '# rows' || e || e || '| a |' || e || '| --- |' || e || '| ' || n || ' |'
WHEN 2 THEN '# server' || e || e || '- **port**: 80' || k || e || '- **host**: ' || n WHEN 3 THEN '# ' || n || e || e || '- one' || e || '- ' || k ELSE '# ' || n || e || e || '| a | b |' || e || '| --- | --- |' || e || '| ' || k || ' | x |' || e END END AS text FROM f""")
def files_imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.imported(customer_files(spark, sf_dir))


@query(f"""WITH {FILES}, t AS (SELECT *, CASE WHEN k % 50 = 6 THEN 'broken' WHEN k % 50 = 9 THEN 'extension' END AS error, '## Sheet1' || e || e AS h FROM f)
SELECT 'in/' || n || CASE WHEN k % 50 = 9 THEN '.exe' ELSE ext END AS path, 'in/' || n || '.xlsx' AS output, CASE WHEN error IS NULL THEN 'success' ELSE 'failed' END AS status, error,
CASE WHEN error IS NULL THEN h || CASE k % 5 WHEN 0 THEN '| name | key |  |' || e || '| --- | --- | --- |' || e || '| ' || n || ', the |  |  |' || e || '| ' || k || ' | 1 | 2 |' WHEN 1 THEN '| • title: ' || n || ' |' || e || '| --- |' || e || '|  |' || e || '| settings |' || e || '|  |' || e || '| • key: ' || k || ' |' || e || '|  |' || e || '| rows |' || e || '|  |' || e || '| a |' || e || '| ' || n || ' |'
WHEN 2 THEN '| server |' || e || '| --- |' || e || '|  |' || e || '| • port: 80' || k || ' |' || e || '| • host: ' || n || ' |' WHEN 3 THEN '| ' || n || ' |' || e || '| --- |' || e || '|  |' || e || '| • one |' || e || '| • ' || k || ' |' ELSE '| ' || n || ' |  |' || e || '| --- | --- |' || e || '|  |  |' || e || '| a | b |' || e || '| ' || k || ' | x |' END END AS text FROM t""")
def files_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file to a workbook, and the workbooks read again."""
    made = convert.converted(customer_files(spark, sf_dir), ".xlsx")
    made = made.select(F.col("output").alias("path"), "content", F.col("content").isNull().alias("whole"), F.col("path").alias("given"), "status", F.col("error").alias("failed"))
    back = files.imported(made, keep=("given", "status", "failed"))
    return back.select(F.col("path").alias("output"), F.col("given").alias("path"), "status", F.col("failed").alias("error"), "text")


#: Files made of parts: extension, content, and the problem that a check must find.
SAMPLES: list[tuple[str, bytes, str | None]] = [
    (".md", b"# fine", None), (".md", b"a\x00b", "binary"), (".md", b"\xff\xfe broken", "encoding"), (".csv", b"a\x00b", None), (".json", b'{"a": [1, 2]}', None), (".json", b"{broken json", "broken"), (".json", b"\xef\xbb\xbf[1]", None), (".json", b"", "empty"),
    (".yaml", b"a: [1, 2]", None), (".yml", b"a: [1, 2", "broken"), (".docx", b"PK\x03\x04garbage", "broken"), (".xlsx", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "encrypted"), (".pptx", b"text", "not a zip"), (".pdf", b"%PDF-1.7", None), (".pdf", b"PDF", "not a PDF"), (".xls", b"\xd0\xcf\x11\xe0", "not a workbook"), (".exe", b"MZ", "extension"), (".lnk", b"L", "shortcut"),
]


@query("SELECT 'in/' || p_partkey || ext AS path, problem FROM part JOIN (VALUES " + ", ".join(f"({k}, '{ext}', {f"'{problem}'" if problem else 'NULL'})" for k, (ext, _, problem) in enumerate(SAMPLES)) + f") AS v(k, ext, problem) ON p_partkey % {len(SAMPLES)} = k")
def file_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole and broken files of every format, by their whole content."""
    made = spark.createDataFrame([(k, ext, bytearray(raw)) for k, (ext, raw, _) in enumerate(SAMPLES)], "k int, ext string, content binary")
    x = table(spark, sf_dir, "part").join(F.broadcast(made), F.col("p_partkey") % len(SAMPLES) == F.col("k"))
    return catalog.checked(x.select(F.concat(F.lit("in/"), F.col("p_partkey").cast("string"), "ext").alias("path"), F.octet_length("content").cast("long").alias("length"), "content")).select("path", "problem")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'missing' WHEN p_partkey % 5 = 4 THEN 'extension' WHEN p_size = 1 THEN 'empty' WHEN p_size = 50 THEN 'too large' WHEN p_partkey % 5 = 0 AND p_partkey % 3 = 0 THEN 'not a zip' END AS problem FROM part""")
def archive_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    ext = F.element_at(F.array(*map(F.lit, [".zip", ".TAR", ".tar.gz", ".7z", ".txt"])), (k % 5 + 1).cast("int"))
    size = F.when(k % 7 == 0, F.lit(None)).when(F.col("p_size") == 1, 0).when(F.col("p_size") == 50, (1 << 31) + 1).otherwise(F.col("p_size"))
    x = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("in/a"), ext).alias("path"), size.cast("long").alias("length"), F.when(k % 3 == 0, F.lit(b"xx")).otherwise(F.lit(b"PK\x03\x04")).alias("head"))
    return catalog.archive_problem(x).select("p_partkey", "problem")


@query("""WITH s AS (SELECT s_nationkey AS doc, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS row_no, s_name FROM supplier) SELECT doc::VARCHAR AS path, row_no::INT AS row_no, s_name AS cell FROM s UNION ALL SELECT DISTINCT doc::VARCHAR, 0, 's_name' FROM s""")
def workbook_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of each nation as a table, as a workbook, and its cells."""
    made = tables.rendered(table(spark, sf_dir, "supplier"), ["s_nationkey"], ["s_suppkey"], ["s_name"])
    books = convert.exported(made.select(F.col("s_nationkey").cast("string").alias("path"), "text"), ".xlsx")
    return files.workbook_cells(books).where("cell <> ''").select("path", "row_no", "cell")


@query()
def pages_to_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages over Markdown to word-processor files and back."""
    text = table(spark, sf_dir, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".docx")).alias("path"), html_to_markdown(F.col("html")).alias("text"))
    return files.imported(convert.exported(text, ".docx"))


@query("SELECT n_nationkey AS media_id, 0 AS seq, n_nationkey / 1000 AS start, n_name || ' said' AS text FROM nation UNION ALL SELECT n_nationkey, 2, 1.5, n_name FROM nation")
def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = lambda at, *t: F.struct(F.lit(at).cast("long").alias("tStartMs") if isinstance(at, int) else at.cast("long").alias("tStartMs"), F.array(*(F.struct(x.alias("utf8")) for x in t)).alias("segs"))
    name = F.col("n_name")
    made = F.to_json(F.struct(F.array(event(F.col("n_nationkey"), name, F.lit(" said")), event(1000, F.lit(" ")), event(1500, name)).alias("events")))
    return transcript.captions(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("media_id"), made.alias("json")), "json")


@query("""WITH c AS (SELECT o_custkey, o_orderkey AS seq, CASE o_orderstatus WHEN 'F' THEN 'manual' WHEN 'O' THEN 'auto' ELSE 'other' END AS kind FROM orders)
SELECT o_custkey, arg_min(kind, (CASE kind WHEN 'manual' THEN 0 WHEN 'auto' THEN 1 ELSE 1048576 END, seq)) AS kind, arg_min(seq, (CASE kind WHEN 'manual' THEN 0 WHEN 'auto' THEN 1 ELSE 1048576 END, seq)) AS seq FROM c GROUP BY 1""")
def preferred_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "F", "manual").when(F.col("o_orderstatus") == "O", "auto").otherwise("other")
    x = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("seq"), kind.alias("kind"))
    return transcript.preferred(x, "o_custkey", {"manual": 0, "auto": 1})


@query("""WITH a AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS s FROM embeddings), m AS (SELECT vec_id, s, list_avg(s) AS mean FROM a), p AS (SELECT *, list_max(list_transform(s, lambda x: abs(x - mean))) AS peak FROM m),
g AS (SELECT *, CASE WHEN peak > 1e-4 THEN least(0.9 / peak, 10.0) ELSE 1.0 END AS gain FROM p) SELECT vec_id, round(mean, 6) AS mean, round(gain, 6) AS gain, round(list_max(list_transform(s, lambda x: greatest(least((x - mean) * gain, 1.0), -1.0))), 6) AS top FROM g""")
def audio_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("samples"))
    out = transcript.normalised_audio(x)
    return out.select("vec_id", F.round("mean", 6).alias("mean"), F.round("gain", 6).alias("gain"), F.round(F.array_max("samples"), 6).alias("top"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity < 10 OR (l_suppkey % 20 < 12 AND l_quantity < 14) OR l_partkey % 10 = 9 AS artifact, count(*) AS n FROM lineitem GROUP BY ALL""")
def image_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("double")
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit(500).alias("bytes"), (q + 6).alias("width"), (q + 8).alias("height"), q.alias("std"), (F.col("l_suppkey") % 20).alias("colour"), (F.col("l_partkey") % 10 / 10).alias("centre_blank"), F.lit(0.1).alias("white"), F.lit(0.1).alias("page_share"), F.lit(True).alias("has_text"))
    return layout.image_artifacts(x).groupBy("l_orderkey", "l_linenumber", "artifact").agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT l_orderkey AS link_id, 'u' || l_partkey AS uri FROM lineitem), a AS (SELECT CASE p_size % 3 WHEN 0 THEN 'path' WHEN 1 THEN 'folder' ELSE 'name' END AS kind, 'u' || p_partkey AS uri, 'assets/' || p_brand || '.png' AS path FROM part),
b AS (SELECT link_id, arg_min(path, (CASE kind WHEN 'path' THEN 0 WHEN 'folder' THEN 1 ELSE 2 END, path)) AS path FROM l JOIN a USING (uri) GROUP BY 1) SELECT DISTINCT link_id, path FROM l LEFT JOIN b USING (link_id)""")
def resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") % 3 == 0, "path").when(F.col("p_size") % 3 == 1, "folder").otherwise("name")
    assets = part.select(kind.alias("kind"), F.concat(F.lit("u"), F.col("p_partkey").cast("string")).alias("uri"), F.concat(F.lit("assets/"), "p_brand", F.lit(".png")).alias("path"))
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("link_id"), F.concat(F.lit("u"), F.col("l_partkey").cast("string")).alias("uri"))
    return catalog.resolved(links, assets, ["path", "folder", "name"]).select("link_id", "path").distinct()


@query("SELECT doc_id AS session, source AS store, doc_id * 7919 % 1000003 AS mtime FROM documents WHERE doc_id % 5 <> 0 AND 1000003 - doc_id * 7919 % 1000003 > 604800")
def cache_outdated(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("session"), F.col("source").alias("store"), (F.col("doc_id") * 7919 % 1000003).alias("mtime"), (F.col("doc_id") % 5 == 0).alias("protected"))
    return catalog.outdated(x, F.lit(1000003)).drop("protected")


@query("SELECT o_orderpriority, 'f' || o_orderkey || '.md' AS file, 'E' || o_custkey AS error FROM orders WHERE o_orderstatus = 'O'")
def batch_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "failed").otherwise("skipped")
    x = table(spark, sf_dir, "orders").select("o_orderpriority", F.concat(F.lit("in/x/f"), F.col("o_orderkey").cast("string"), F.lit(".md")).alias("path"), status.alias("status"), F.concat(F.lit("E"), F.col("o_custkey").cast("string")).alias("error"))
    return catalog.error_list(x)


@query("""SELECT source, count(*) AS n_files, sum(n_chars)::BIGINT AS size FROM documents GROUP BY 1""")
def storage_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n_files"), F.sum("n_chars").alias("size"))


@query(f"""WITH {ISLANDS}, r AS (SELECT doc_id, island, {CELLS} AS cells, min(line_no) OVER (PARTITION BY doc_id, island) AS first FROM i WHERE line LIKE '%|%' AND NOT {SEP}), w AS (SELECT doc_id, unnest(cells) AS c, generate_subscripts(cells, 1) - 1 AS col_no FROM r)
SELECT doc_id, col_no::INT AS col_no, least(max(length(c)) + 5, 60)::INT AS width FROM w GROUP BY 1, 2""")
def table_column_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.column_widths(tables.table_lines(lines.lines(table(spark, sf_dir, "documents")), least=1).select("doc_id", "cells"))


@query(rf"""WITH {ISLANDS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, island ORDER BY line_no) AS row_no, {CELLS} AS cells FROM i WHERE line LIKE '%|%' AND NOT {SEP}),
w AS (SELECT *, count(*) OVER (PARTITION BY doc_id, island) AS n, max(len(cells)) OVER (PARTITION BY doc_id, island) AS width FROM r), t AS (SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY island) AS table_no, row_no, list_resize(cells, width, '') AS cells FROM w WHERE n >= 2),
x AS (SELECT *, list_filter(regexp_split_to_array(array_to_string(cells, ' '), '\s+'), lambda y: y <> '') AS words FROM t)
SELECT doc_id, table_no, row_no, len(cells) < 2 OR len(regexp_split_to_array(cells[1], '\s+')) > 15 OR len(list_filter(words, lambda y: length(y) <= 2)) / greatest(len(words), 1) > 0.35 AND coalesce(list_sum(list_transform(words, lambda y: length(y))), 0) / greatest(len(words), 1) < 3.5
OR len(list_filter(cells, lambda y: length(y) > 20)) > 0 AND len(list_filter(cells, lambda y: y = '')) > 0 AS prose FROM x""")
def pseudo_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table rows found in documents, and whether each is prose with a pipe in it."""
    x = tables.table_lines(lines.lines(table(spark, sf_dir, "documents")))
    return x.select("doc_id", "table_no", "row_no", tables.looks_like_prose(F.col("cells")).alias("prose"))


# ---- previews and slides


@query(rf"""WITH {LINES_SQL}, s AS (SELECT *, {STRIPPED} AS s FROM l), b AS (SELECT *, lag(s) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM s),
g AS (SELECT *, coalesce(regexp_matches(s, '^\p{{Ll}}') AND before <> '' AND NOT regexp_matches(before, '^(#|[-*•] |\d+[.)] |\|)') AND NOT regexp_matches(before, '[.!?:]$'), false) AS goes_on FROM b)
SELECT doc_id, line_no, sum((NOT goes_on)::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS paragraph_no FROM g""")
def wrapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preview.wrapped_lines_joined(lines.lines(table(spark, sf_dir, "documents"))).select("doc_id", "line_no", "paragraph_no")


@query(f"WITH {LINES_SQL} SELECT doc_id, line_no, greatest(1, ceil(length(line) / greatest(35, 75 - 5 * (line_no % 10))))::INT AS visual_lines, round(0.26 * greatest(1, ceil(length(line) / greatest(35, 75 - 5 * (line_no % 10)))) + 0.18, 2) AS height FROM l")
def line_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = lines.lines(table(spark, sf_dir, "documents")).withColumn("level", F.col("line_no") % 10)
    return preview.line_heights(x).select("doc_id", "line_no", "visual_lines", "height")


@query()
def slide_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = lines.lines(table(spark, sf_dir, "documents")).withColumns({"level": F.lit(0), "slide_no": F.lit(1)})
    return preview.slide_pages(preview.line_heights(x))


@query(f"WITH {MARKDOWN_SQL}, b AS (SELECT doc_id, text, strpos(text, '![') AS i, length('![map](maps/' || doc_id || '.png)') AS n FROM m) SELECT doc_id, 1::INT AS block_no, 'text' AS kind, md5(substr(text, 1, i - 1)) AS digest FROM b UNION ALL SELECT doc_id, 2, 'image', md5('maps/' || doc_id || '.png') FROM b UNION ALL SELECT doc_id, 3, 'text', md5(substr(text, i + n)) FROM b")
def preview_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = markdown(spark, sf_dir)
    out = preview.blocks(docs, images.image_tokens(docs))
    return out.select("doc_id", "block_no", "kind", F.md5(F.col("value").cast("binary")).alias("digest"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN '.mp3' WHEN 1 THEN '.wav' ELSE '.mp4' END AS ext, 'a' || event_type AS name FROM events")
def download_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 3
    mime, name = F.when(k == 0, "audio/MPEG; x=1").otherwise("text/plain"), F.when(k == 1, "x.WAV").otherwise("none")
    return table(spark, sf_dir, "events").select("event_id", preview.guessed_extension(mime, name).alias("ext"), preview.default_name(F.concat(F.lit("text\n## a?"), "event_type")).alias("name"))


@query("WITH r AS (SELECT l_orderkey AS doc_id, (l_linenumber * 100000 + l_partkey) * 1000 + l_suppkey AS seq FROM lineitem), b AS (SELECT doc_id, ((row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1) // 3)::INT AS batch_no, seq FROM r) SELECT doc_id, batch_no, string_agg('p' || seq, chr(10) || '<<<SEG>>>' || chr(10) ORDER BY seq) AS text, count(*) AS n FROM b GROUP BY 1, 2")
def translation_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = (F.col("l_linenumber") * 100000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey")
    x = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), seq.alias("seq"), F.concat(F.lit("p"), seq.cast("string")).alias("line"))
    return preview.batches(x, "seq", 3)


@query()
def merged_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preview.merged_columns(tables.table_lines(lines.lines(table(spark, sf_dir, "documents")))).select("doc_id", "table_no", "row_no", F.size("cells").alias("n_cells"))


# ---- tabs, settings, edits


@query("""WITH t AS (SELECT l_orderkey AS win, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS place, l_linenumber AS tab, count(*) OVER (PARTITION BY l_orderkey) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)), c AS (SELECT o_orderkey AS win, o_custkey % 6 + 1 AS tab, CASE WHEN o_custkey % 2 = 0 THEN o_custkey % 6 + 1 ELSE 1 END AS active FROM orders),
x AS (SELECT c.*, g.place AS "at", (SELECT max(n) FROM t WHERE t.win = c.win) AS n FROM c LEFT JOIN t g ON g.win = c.win AND g.tab = c.tab WHERE EXISTS (SELECT 1 FROM t WHERE t.win = c.win)),
y AS (SELECT *, CASE WHEN n = 1 THEN NULL WHEN "at" = n - 1 THEN "at" - 1 ELSE "at" + 1 END AS heir FROM x)
SELECT y.win AS "window", CASE WHEN "at" IS NULL OR active <> y.tab THEN active ELSE t.tab END AS active FROM y LEFT JOIN t ON t.win = y.win AND t.place = heir""")
def tabs_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    tabs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct().select(F.col("l_orderkey").alias("window"), (F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber")) - 1).alias("place"), F.col("l_linenumber").cast("long").alias("tab"))
    gone = (F.col("o_custkey") % 6 + 1).cast("long")
    closed = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("window"), gone.alias("tab"), F.when(F.col("o_custkey") % 2 == 0, gone).otherwise(F.lit(1).cast("long")).alias("active"))
    return workspace.active_after_close(tabs, closed)


@query("""WITH t AS (SELECT l_orderkey AS win, list(DISTINCT l_linenumber ORDER BY l_linenumber) AS tabs FROM lineitem GROUP BY 1), m AS (SELECT o_orderkey AS win, o_custkey % 6 + 1 AS source, o_custkey % 5 + 1 AS target FROM orders),
x AS (SELECT win, tabs, source, list_position(tabs, target) AS b, list_filter(tabs, lambda y: y <> source) AS rest, source IS NOT NULL AND source <> target AND list_contains(tabs, source) AND list_contains(tabs, target) AS moves FROM t LEFT JOIN m USING (win)),
y AS (SELECT win, CASE WHEN moves THEN rest[1:b - 1] || [source] || rest[b:] ELSE tabs END AS tabs FROM x)
SELECT win AS "window", unnest(tabs) AS tab, generate_subscripts(tabs, 1) - 1 AS place FROM y""")
def tabs_reordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    tabs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct().select(F.col("l_orderkey").alias("window"), (F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber")) - 1).alias("place"), F.col("l_linenumber").cast("long").alias("tab"))
    moves = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("window"), (F.col("o_custkey") % 6 + 1).alias("source"), (F.col("o_custkey") % 5 + 1).alias("target"))
    return workspace.reordered(tabs, moves)


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'dark' ELSE 'light' END AS theme, CASE WHEN event_id % 4 < 2 THEN event_id::VARCHAR ELSE '14' END AS size FROM events""")
def stored_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, i = F.col("event_id") % 4, F.col("event_id").cast("string")
    made = F.when(k == 0, F.concat(F.lit('{"theme": "dark", "size": '), i, F.lit(', "other": 1}'))).when(k == 1, F.concat(F.lit('{"size": "'), i, F.lit('"}'))).when(k == 2, "{broken").otherwise(F.lit(None))
    return workspace.stored(table(spark, sf_dir, "events").select("event_id", made.alias("json")), {"theme": "light", "size": "14"})


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'draft' WHEN 1 THEN 'made' ELSE s_name END AS text FROM supplier")
def drafts_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 4
    return table(spark, sf_dir, "supplier").select("s_suppkey", workspace.first_filled(F.when(k == 0, "draft").when(k == 2, " \n"), F.when(k == 1, "made").when(k == 3, ""), F.col("s_name")).alias("text"))


@query("SELECT * FROM (SELECT p_name AS path, p_partkey % 7 = 0 AS pinned, p_size AS last_opened, 'file' AS kind FROM part UNION ALL SELECT p_brand || p_partkey, p_partkey % 5 = 0, p_partkey, 'folder' FROM part) ORDER BY pinned DESC, last_opened DESC, path LIMIT 40")
def history_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    files_ = part.select(F.col("p_name").alias("path"), (k % 7 == 0).alias("pinned"), F.col("p_size").cast("long").alias("last_opened"))
    folders = part.select(F.concat("p_brand", k.cast("string")).alias("path"), (k % 5 == 0).alias("pinned"), k.cast("long").alias("last_opened"))
    return workspace.history(files_, folders, 40)


@query("SELECT 'f' || p_partkey AS path, (p_partkey % 3 = 0) <> (p_partkey % 10 = 0) AS pinned FROM part WHERE p_size % 5 > 0")
def history_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some pins turned, and some items removed."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    path = F.concat(F.lit("f"), k.cast("string")).alias("path")
    items = workspace.pins_toggled(part.select(path, (k % 3 == 0).alias("pinned")), part.where(k % 10 == 0).select(path))
    return workspace.removed(items, part.where(F.col("p_size") % 5 == 0).select(path))


@query("SELECT lower(n_name) AS code, CASE n_nationkey % 3 WHEN 0 THEN n_name ELSE lower(n_name) END AS name, CASE n_nationkey % 3 WHEN 0 THEN 'N' || n_nationkey ELSE lower(n_name) END AS native_name FROM nation")
def locale_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    made = F.when(k % 3 == 0, F.to_json(F.struct(F.struct(F.col("n_name").alias("name"), F.concat(F.lit("N"), k.cast("string")).alias("native_name")).alias("_meta"), F.lit("x").alias("key")))).when(k % 3 == 1, '{"key": "x"}').otherwise("[broken")
    return workspace.locales(table(spark, sf_dir, "nation").select(F.lower("n_name").alias("code"), made.alias("json")))


@query("SELECT s_suppkey, s_name || ' (' || s_suppkey % 12 || ' Cores' || CASE WHEN s_suppkey % 3 > 0 THEN ' @ ' || printf('%.1f', s_suppkey % 3 * 1.5) || 'GHz' ELSE '' END || ') | ' || printf('%.1f', (s_suppkey % 32)::DOUBLE) || 'GB RAM | GPU: ' || CASE s_suppkey % 4 WHEN 0 THEN 'CPU/Integrated Graphics' WHEN 1 THEN 'card' ELSE 'card (' || printf('%.1f', (s_suppkey % 4 * 2)::DOUBLE) || 'GB VRAM)' END AS summary FROM supplier")
def hardware_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    vram = F.when(k % 4 > 1, k % 4 * 2048.0)
    return table(spark, sf_dir, "supplier").select("s_suppkey", workspace.hardware_summary(F.col("s_name"), k % 12, k % 3 * 1500.0, (k % 32).cast("double"), F.when(k % 4 == 0, "").otherwise("card"), vram).alias("summary"))


@query("SELECT doc_id, substr(md5('d/' || doc_id || '_' || doc_id * 3 || '_' || n_chars), 1, 12) AS session FROM documents")
def session_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", workspace.session_id(F.concat(F.lit("d/"), i.cast("string")), i * 3, F.col("n_chars")).alias("session"))


@query("""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, doc_id % 90 AS a, doc_id % 90 + doc_id % 50 AS b FROM documents),
f AS (SELECT *, length(substr(text, 1, 0)) AS z, strpos(text, 'tion') AS i FROM t)
SELECT doc_id, md5(substr(text, 1, least(a, length(text))) || '+' || substr(text, least(b, length(text)) + 1)) AS inserted, md5(CASE WHEN i = 0 THEN text ELSE substr(text, 1, i - 1) || '#' || substr(text, i + 4) END) AS replaced FROM f""")
def text_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range replaced, and a token that isn't where it is said to be."""
    i, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    a = (i % 90).cast("int")
    x = table(spark, sf_dir, "documents").select("doc_id", workspace.inserted(text, a, a + (i % 50).cast("int"), F.lit("+")).alias("inserted"), workspace.token_replaced(text, F.lit(1 << 29), F.lit("tion"), F.lit("#")).alias("replaced"))
    return x.select("doc_id", *(F.md5(F.col(c).cast("binary")).alias(c) for c in ("inserted", "replaced")))


# ---- pages put together


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE l_partkey END, l_linenumber * 100000 + l_suppkey) AS place, l_suppkey FROM lineitem")
def shapes_by_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_linenumber") * 100000 + F.col("l_suppkey")).alias("shape_no"), F.when(F.col("l_suppkey") % 3 > 0, F.col("l_partkey")).alias("top"))
    return workspace.by_top(x, "l_orderkey").select("l_orderkey", "l_linenumber", "place", "l_suppkey")


@query("""WITH r AS (SELECT l_orderkey AS page, (l_linenumber * 100)::DOUBLE AS top, (l_linenumber * 100 + l_quantity * 3)::DOUBLE AS bottom FROM lineitem), h AS (SELECT page, max(bottom) AS e FROM r GROUP BY 1),
x AS (SELECT *, coalesce(max(bottom) OVER (PARTITION BY page ORDER BY top, bottom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM r),
e AS (SELECT page, 'table' AS type, top AS a, bottom AS b FROM x UNION ALL SELECT page, 'text', above, top FROM x WHERE top > above + 2 UNION ALL SELECT page, 'text', e, 800.0 FROM h WHERE e < 798)
SELECT page, type, a AS "from", b AS "to", row_number() OVER (PARTITION BY page ORDER BY CASE type WHEN 'table' THEN a ELSE b END, type DESC, b) AS elem_no FROM e""")
def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    regions = x.select(F.col("l_orderkey").alias("page"), (F.col("l_linenumber") * 100).cast("double").alias("top"), (F.col("l_linenumber") * 100 + F.col("l_quantity") * 3).cast("double").alias("bottom"))
    return workspace.text_between(regions, regions.select("page", F.lit(800.0).alias("height")).distinct())


@query("SELECT l_suppkey AS page, l_linenumber AS line_no, round(avg(l_quantity::DOUBLE), 6) AS size FROM lineitem GROUP BY 1, 2")
def font_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), F.col("l_linenumber").alias("line_no"), F.col("l_quantity").cast("double").alias("size"))
    return workspace.mean_font_sizes(x).withColumn("size", F.round("size", 6))


@query("""WITH p AS (SELECT l_suppkey AS image, l_linenumber - 1 AS y, l_partkey % 8 AS x, l_partkey % 256 AS r, l_orderkey % 256 AS g, (l_partkey + l_orderkey) % 256 AS b, l_partkey % 41 AS a FROM lineitem), c AS (SELECT image, unnest([r, g, b])::DOUBLE AS v FROM p WHERE a > 20), s AS (SELECT image, round(stddev_pop(v), 4) AS std FROM c GROUP BY 1),
q AS (SELECT image, round(avg(abs(r - g) + abs(g - b)) FILTER (WHERE a > 20), 6) AS colour, round(count(*) FILTER (WHERE least(r, g, b) >= 235) / count(*), 6) AS white, round(count(*) FILTER (WHERE y >= 1 AND y < 5 AND x >= 2 AND x < 6 AND (least(r, g, b) >= 235 OR a < 20)) / nullif(count(*) FILTER (WHERE y >= 1 AND y < 5 AND x >= 2 AND x < 6), 0), 6) AS centre_blank FROM p GROUP BY 1)
SELECT image, std, colour, white, centre_blank FROM q LEFT JOIN s USING (image)""")
def pixel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, o = F.col("l_partkey"), F.col("l_orderkey")
    x = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("image"), (F.col("l_linenumber") - 1).alias("row"), (p % 8).alias("col"), (p % 256).alias("r"), (o % 256).alias("g"), ((p + o) % 256).alias("b"), (p % 41).alias("a"), F.lit(7).alias("height"), F.lit(8).alias("width"))
    return workspace.pixel_stats(x).select("image", F.round("std", 4).alias("std"), *(F.round(c, 6).alias(c) for c in ("colour", "white", "centre_blank")))


@query(r"""WITH c AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'see (' || p_brand WHEN 1 THEN p_type || '-' WHEN 2 THEN p_brand || ' ab' ELSE p_name END AS a, CASE p_partkey % 5 WHEN 0 THEN 'two) ' || p_size WHEN 2 THEN 'cd' || p_brand ELSE p_name END AS b FROM part)
SELECT p_partkey, coalesce(a LIKE '%(%' AND b LIKE '%)%' OR a LIKE '%-' OR regexp_matches(regexp_extract(a, '(\S+)$', 1), '^\p{L}{1,2}$') AND regexp_matches(regexp_extract(b, '^(\S+)', 1), '^\p{Ll}\p{L}*$'), false) AS cut FROM c""")
def split_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    a = F.when(k == 0, F.concat(F.lit("see ("), "p_brand")).when(k == 1, F.concat("p_type", F.lit("-"))).when(k == 2, F.concat("p_brand", F.lit(" ab"))).otherwise(F.col("p_name"))
    b = F.when(k == 0, F.concat(F.lit("two) "), F.col("p_size").cast("string"))).when(k == 2, F.concat(F.lit("cd"), "p_brand")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", workspace.words_split(F.array(F.lit(""), a, F.lit(" "), b)).alias("cut"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_suppkey, ['x', CASE WHEN l_partkey % 2 = 0 THEN '' ELSE 'p' END, CASE l_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'end.' ELSE 'go' END] AS a, [CASE WHEN l_suppkey % 2 = 0 THEN '' ELSE 'k' END, CASE WHEN l_suppkey % 3 = 0 THEN 'q' ELSE '' END, CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE 'r' END] AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, l_suppkey, b[1] = '' AND (a[2] = '' AND b[2] <> '' OR a[3] = '' AND b[3] <> '' OR a[3] <> '' AND b[3] <> '' AND right(a[3], 1) NOT IN ('.', '!', '?', ':')) AS goes_on FROM r""")
def table_rows_go_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = F.col("l_partkey"), F.col("l_suppkey")
    a = F.array(F.lit("x"), F.when(p % 2 == 0, "").otherwise("p"), F.when(p % 3 == 0, "").when(p % 3 == 1, "end.").otherwise("go"))
    b = F.array(F.when(k % 2 == 0, "").otherwise("k"), F.when(k % 3 == 0, "q").otherwise(""), F.when(k % 5 == 0, "").otherwise("r"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", workspace.rows_go_on(a, b).alias("goes_on"))


# ---- operators that the queries above don't reach


@query("SELECT p_partkey, regexp_replace('a/' || p_name || '.TXT', '\\.[^./]*$', '') || '.md' AS path FROM part")
def swapped_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.swapped_extension(F.concat(F.lit("a/"), "p_name", F.lit(".TXT")), F.lit(".md")).alias("path"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN n_cols >= 3 AND short > 0.35 AND mean < 3.8 OR n_cols = 2 AND short > 0.4 AND mean < 3.8 OR n <= 3 AND mean <= 3.0 THEN true ELSE false END AS noise FROM (SELECT *, l_linenumber % 4 + 1 AS n_cols, l_partkey % 10 / 10.0 AS short, l_suppkey % 6 + 0.5 AS mean, l_linenumber AS n FROM lineitem)")
def drawing_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_linenumber") % 4 + 1).alias("n_cols"), (F.col("l_partkey") % 10 / 10).alias("short"), (F.col("l_suppkey") % 6 + 0.5).alias("mean"), F.col("l_linenumber").alias("n_words"))
    return layout.graphic_noise(x).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "noise")


@query("SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey % 5 - 1 >= 0 AND l_partkey % 7 - 1 >= 0")
def glyphs_on_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_suppkey") % 5 - 1).alias("top"), (F.col("l_partkey") % 7 - 1).alias("x0"))
    return layout.on_page(x).drop("top", "x0")


@query(f"""WITH {LINES_SQL}, o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l),
h AS (SELECT doc_id, start, unnest(list_filter(generate_series(1, length(line) - 3), lambda i: substr(line, i, 4) = 'tion')) AS i FROM o), n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start, i) AS hit_no, count(*) OVER (PARTITION BY doc_id) AS n FROM h)
SELECT doc_id, hit_no, CASE WHEN hit_no = n THEN 1 ELSE hit_no + 1 END AS next_no, CASE WHEN hit_no = 1 THEN n ELSE hit_no - 1 END AS prev_no FROM n""")
def hit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.neighbours(search.hits(table(spark, sf_dir, "documents"), "tion")).select("doc_id", "hit_no", "next_no", "prev_no")


@query("SELECT p_partkey, '- ' || p_name || chr(10) || '  - ' || p_brand || chr(10) || 'a • b' AS text FROM part")
def bullets_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("•"), "p_name", F.lit("\n  ▪  "), "p_brand", F.lit("\na • b"))
    return table(spark, sf_dir, "part").select("p_partkey", lines.bullets_repaired(text).alias("text"))


#: A talk of every customer: a player's address, stamped lines, tags in and outside tables and code.
TALKS = """t AS (SELECT c_custkey AS doc_id, substr(md5(c_name), 1, 11) AS v, c_custkey % 3 = 0 AS has, c_name FROM customer)"""


def talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    video = F.substring(F.md5(F.col("c_name").cast("binary")), 1, 11)
    head = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("see https://youtu.be/"), video)).otherwise("no video")
    text = F.concat(F.lit("# "), F.col("c_name"), F.lit("\n"), head, F.lit("\n**[01:15]** Hi<br>there\n| a<BR/>b |\n```\nx<br>y\n```"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), text.alias("text"))


@query(f"""WITH {TALKS}, l AS (SELECT doc_id, unnest([0, 1, 2, 3, 4, 5, 6]) AS line_no, unnest(['# ' || c_name, CASE WHEN has THEN 'see https://youtu.be/' || v ELSE 'no video' END, CASE WHEN has THEN '**[[01:15]](yt://' || v || '?t=75)** Hi' ELSE '**[01:15]** Hi' END || chr(10) || 'there', '| a' || chr(8232) || 'b |', '```', 'x<br>y', '```']) AS line FROM t) SELECT doc_id, line_no::INT AS line_no, line FROM l""")
def previewed_talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line ends shown and stamps linked into the player."""
    return preview.stamps_linked(preview.breaks_shown(lines.fenced(lines.lines(talks(spark, sf_dir))))).select("doc_id", "line_no", "line")


@query(f"WITH {TALKS} SELECT doc_id, CASE WHEN has THEN v END AS video, c_name AS title FROM t")
def talk_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preview.video_and_title(talks(spark, sf_dir))


@query("""WITH r AS (SELECT o_custkey AS doc_id, 1 AS table_no, o_orderkey AS row_no, [o_orderstatus, CASE WHEN o_custkey % 2 = 0 THEN '' ELSE o_orderpriority END, ' '] AS cells FROM orders)
SELECT doc_id, table_no, row_no, list_filter(cells, lambda c, i: i = 1 OR i = 2 AND doc_id % 2 = 1) AS cells FROM r""")
def filled_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array("o_orderstatus", F.when(F.col("o_custkey") % 2 == 0, "").otherwise(F.col("o_orderpriority")), F.lit(" "))
    x = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.lit(1).alias("table_no"), F.lit("T").alias("table_name"), F.col("o_orderkey").alias("row_no"), cells.alias("cells"))
    return tables.without_empty_columns(x).select("doc_id", "table_no", "row_no", "cells")


@query("SELECT 'd/' || c_custkey || '.md' AS path, '- **name**: ' || c_name || chr(10) || '- **key**: ' || c_custkey AS text FROM customer")
def trees_exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects as Markdown, written as YAML files and read again."""
    made = F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_custkey").alias("key")))
    x = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name")).select(F.concat(F.lit("d/"), F.col("c_custkey").cast("string"), F.lit(".yaml")).alias("path"), json_to_markdown(made).alias("text"))
    return files.imported(convert.exported(x, ".yaml")).select(F.regexp_replace("path", "yaml$", "md").alias("path"), "text")


@query(f"WITH {MARKDOWN_SQL} SELECT doc_id, count(*) AS n_slides FROM (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(['a', 'b']) AS s FROM m)) GROUP BY 1")
def slides_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown to slide files, and the slides that are read from them: the notes of
    the second one stand on it, so each document has two."""
    made = convert.exported(markdown(spark, sf_dir).select(F.concat(F.col("doc_id").cast("string"), F.lit(".pptx")).alias("path"), "text"), ".pptx")
    back = files.imported(made).where("error is null")
    return back.select(F.regexp_extract("path", r"^(\d+)", 1).cast("long").alias("doc_id"), F.size(F.split("text", "\n\n---\n\n")).cast("long").alias("n_slides"))


#: Tables by what is wrong with them: their rows, with a part's name put in.
PSEUDO: list[tuple[list[list[str]], str | None]] = [
    ([["Name", "Bbbb cccc"], ["{}", "Dddd eeee"]], None),
    ([["", " "], ["", ""]], "empty"),
    ([["{}"], ["x"]], "columns"),
    ([["head", "other"], ["a cell of more than twenty signs {}", ""]], "broken"),
    ([["{}", "b"]], "rows"),
    ([["one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen", "{}"], ["a", "b"]], "prose"),
    ([["A B C", "D E F"], ["G H", "I J K L M"]], "noise"),
    ([["Company", "Product"], ["see Mi", "crosoft {}"]], "split"),
    ([["Company", "Product"], ["## Heading {}", "Product"]], "document"),
    ([["Company", "Product"], ["lists\n- alpha\n- bravo\n- charlie\n- delta\n- echoes\n- {}", "Product"]], "document"),
]


@query("SELECT p_partkey AS doc_id, k AS table_no, problem FROM part CROSS JOIN (VALUES " + ", ".join(f"({k}, {f"'{p}'" if p else 'NULL'})" for k, (_, p) in enumerate(PSEUDO)) + ") AS v(k, problem)")
def table_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = spark.createDataFrame([(k, n, r) for k, (rows, _) in enumerate(PSEUDO) for n, r in enumerate(rows, 1)], "table_no int, row_no int, cells array<string>")
    x = spread(table(spark, sf_dir, "part").select("p_partkey")).crossJoin(F.broadcast(made))  # a fixed set
    cells = F.transform("cells", lambda c: F.replace(c, F.lit("{}"), F.concat(F.lit("Part"), F.col("p_partkey").cast("string"))))
    return workspace.table_guards(x.select(F.col("p_partkey").alias("doc_id"), "table_no", "row_no", cells.alias("cells")))


@query("""WITH c AS (SELECT s_suppkey, s_suppkey % 5 AS k, s_name AS n FROM supplier)
SELECT s_suppkey, array_to_string(CASE k WHEN 0 THEN ['### TOP NEWS', '**7**', '# ' || n, 'text', 'more'] WHEN 1 THEN ['**12**', '# ' || n, 'a', 'b'] WHEN 2 THEN ['a', 'b', 'c', '# ' || n] WHEN 3 THEN ['**3**', '### Not capitals', n, '4'] ELSE ['# ' || n, '### LATE', '# second'] END, '|') AS texts FROM c""")
def slide_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, title = F.col("s_suppkey") % 5, F.concat(F.lit("# "), "s_name")
    of = lambda *t: F.array(*(F.lit(x) if isinstance(x, str) else x for x in t))
    texts = F.when(k == 0, of("### TOP NEWS", "text", title, " 7 ", "", "more", "**7**")).when(k == 1, of("a", "b", title, "12")).when(k == 2, of("a", "b", "c", title)).when(k == 3, of("### Not capitals", F.col("s_name"), "3", "4")).otherwise(of(title, "### LATE", "# second"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(workspace.header_first(texts), "|").alias("texts"))


# ---- pages put together from glyphs, strokes and parts; edits of several passes


def page_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as words on the pages of their suppliers, in one to three columns."""
    kind = F.col("l_suppkey") % 5
    row, column = F.col("l_orderkey") % 30, F.col("l_partkey") % 3
    start = F.when(kind == 0, 40).when(kind == 2, F.element_at(F.array(*map(F.lit, (40, 230, 420))), (column + 1).cast("int"))).when(kind == 4, F.when(column == 0, 430).otherwise(40)).otherwise(F.when(column == 0, 330).otherwise(40))
    x0 = start + F.floor(F.col("l_orderkey") / 30) % 4 * 12 + F.col("l_partkey") % 16 * 0.01
    pool = F.array(*map(F.lit, ["Alpha", "beta,", "gamma", "DELTA", "of", "Epsilon.", "12", "zeta", "ETA", "•", "theta;", "- iota"]))
    word = F.element_at(pool, (F.col("l_partkey") % 12 + 1).cast("int"))
    text = F.when((kind == 4) & (column == 0), "ab").when((kind == 3) & (row % 5 == 3), F.when(column == 0, "HEAD").otherwise("TOP")).otherwise(word)
    size = F.when(row == 0, 24.0).when(row % 9 == 4, 14.0).otherwise(10.0)
    top = row * 26 + F.col("l_linenumber") % 3 * 0.5
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).alias("glyph_no"), x0.cast("double").alias("x0"), (x0 + 30).cast("double").alias("x1"), top.cast("double").alias("top"), (top + size).cast("double").alias("bottom"), text.alias("text"), size.alias("size"), (F.col("l_quantity") > 45).alias("bold"), (F.col("l_quantity") < 3).alias("italic"))


@query()
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_texts(page_glyphs(spark, sf_dir))


@query()
def glyph_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as glyphs all over their suppliers' pages."""
    x = table(spark, sf_dir, "lineitem")
    top = F.col("l_partkey") * 7 % 1500 + F.col("l_linenumber") * 0.25
    x = x.select(F.col("l_suppkey").alias("page"), ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).alias("glyph_no"), (F.col("l_orderkey") % 500).cast("double").alias("x0"), top.alias("top"), (top + F.col("l_quantity") % 9 + 1).alias("bottom"))
    return layout.line_clusters(x).select("page", "glyph_no", "line_no")


@query()
def merged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all documents, whole again where they were wrapped."""
    docs = table(spark, sf_dir, "documents")
    x = lines.lines(docs)
    mark = F.regexp_extract("line", r"^(#{1,3}) ", 1)
    items = x.select("doc_id", "line_no", F.when(mark != "", F.substr(F.col("line"), F.length(mark) + 2)).otherwise(F.col("line")).alias("text"), F.length(mark).alias("level"))
    # lines by their ends, without taking texts apart
    sizes = docs.select("doc_id", (F.length(F.coalesce("text", F.lit(""))) - F.length(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(""))) + 1).alias("n"))
    return pages.joined_lines(items, ["doc_id"], ["line_no"], sizes).select("doc_id", "item_no", "level", "text")


CARDS_SQL = r"""c AS (SELECT p_partkey AS doc_id, unnest([1, 2, 3]) AS col,
  unnest([CASE WHEN p_size % 3 = 0 THEN p_size || chr(10) ELSE '' END || p_brand || chr(10) || p_name || chr(10) || p_type,
          CASE WHEN p_size % 4 = 0 THEN p_type || chr(10) ELSE '' END || CASE WHEN p_size % 5 = 0 THEN lower(p_name) ELSE 'Kind' END || chr(10) || p_type || CASE WHEN p_size % 2 = 0 THEN chr(10) || 'size ' || p_size ELSE '' END,
          CASE WHEN p_size % 7 = 0 THEN 'Price' ELSE 'Price' || chr(10) || floor(p_retailprice)::INT END]) AS cell FROM part),
l AS (SELECT doc_id, col, list_filter(list_transform(string_split(cell, chr(10)), lambda s: trim(s)), lambda s: s <> '') AS lines FROM c),
n AS (SELECT doc_id, col, CASE WHEN regexp_matches(lines[1], '^\d{1,3}$') THEN lines[2:] ELSE lines END AS lines FROM l),
u AS (SELECT doc_id, col, CASE WHEN len(lines) >= 3 AND upper(lines[1]) = lines[1] AND lower(lines[1]) <> lines[1] AND (len(string_split(lines[1], ' ')) <= 2 OR length(lines[1]) <= 5) THEN lines[2:] ELSE lines END AS lines FROM n),
r AS (SELECT doc_id, col, CASE WHEN col = 2 AND len(lines) >= 3 THEN lines[1] END AS title, CASE WHEN col = 2 AND len(lines) >= 3 THEN lines[2:] ELSE lines END AS lines FROM u),
h AS (SELECT doc_id, max(title) AS title, list(coalesce(lines[1], '') ORDER BY col) AS header, list(array_to_string(coalesce(lines[2:], []), '<br>') ORDER BY col) AS body FROM r GROUP BY 1),
b AS (SELECT *, len(list_filter(header, lambda h: h <> '' AND (regexp_matches(h, '^\p{Ll}') OR length(string_split(h, ' ')[-1]) <= 1 OR len(string_split(h, ' ')) > 5))) > 0 AS bad FROM h)"""


@query(f"""WITH {CARDS_SQL} SELECT doc_id, 1 AS table_no, CASE WHEN bad THEN 'rejected' ELSE 'cards' END AS verdict, CASE WHEN NOT bad THEN title END AS title, CASE WHEN NOT bad THEN array_to_string(header, ' / ') END AS header, CASE WHEN NOT bad THEN array_to_string(body, ' / ') END AS body FROM b""")
def card_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as a table of three cards on one row."""
    nl, when = F.lit("\n"), lambda k, of: F.when(F.col("p_size") % k == 0, of).otherwise("")
    size, price = F.col("p_size").cast("string"), F.floor("p_retailprice").cast("string")
    one = F.concat(when(3, F.concat(size, nl)), "p_brand", nl, "p_name", nl, "p_type")
    two = F.concat(when(4, F.concat("p_type", nl)), F.when(F.col("p_size") % 5 == 0, F.lower("p_name")).otherwise("Kind"), nl, "p_type", when(2, F.concat(F.lit("\nsize "), size)))
    three = F.when(F.col("p_size") % 7 == 0, "Price").otherwise(F.concat(F.lit("Price\n"), price))
    x = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("table_no"), F.lit(1).alias("row_no"), F.array(one, two, three).alias("cells"))
    text = lambda c: F.array_join(c, " / ").alias(c)
    return pages.card_tables(x).select("doc_id", "table_no", "verdict", "title", text("header"), text("body"))


@query()
def joined_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as the elements of their suppliers' documents, tables of one to three rows among them."""
    x = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_partkey") % 4 == 0, "text").when(F.col("l_partkey") % 4 == 1, "page_break").otherwise("table")
    x = x.select(F.col("l_suppkey").alias("doc_id"), ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100_000 + F.col("l_partkey")).alias("elem_no"), kind.alias("type"), (F.col("l_orderkey") % 200).alias("n_chars"), (F.col("l_partkey") % 2 + 2).cast("int").alias("n_cols"), F.col("l_quantity").cast("int").alias("q"))
    x = x.groupBy("doc_id", "elem_no", "type", "n_chars", "n_cols").agg(F.max("q").alias("q"))
    own = x.where("type = 'table'")
    columns = own.select("doc_id", "elem_no", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)).alias("col_no"), "q")
    shift = (F.col("q") * (F.col("col_no") + 3)) % 90 - 45
    columns = columns.select("doc_id", "elem_no", "col_no", (F.col("col_no") * 100 + shift).alias("x0"), (F.col("col_no") * 100 + shift + 80).alias("x1"))
    rows = own.select("doc_id", "elem_no", "n_cols", "q", F.explode(F.sequence(F.lit(1), F.col("q") % 3 + 1)).alias("row_no"))
    cell = lambda k: F.when((F.col("q") + F.col("row_no") * 7 + k * 5) % 3 == 0, "").otherwise(F.concat(F.lit("c"), (F.col("q") + k).cast("string"), F.when((F.col("q") + k) % 4 == 0, ".").otherwise("")))
    rows = rows.select("doc_id", "elem_no", "row_no", F.transform(F.sequence(F.lit(0), F.col("n_cols") - 1), cell).alias("cells"))
    return tables.joined(x.select("doc_id", "elem_no", "type", "n_chars", "n_cols"), columns, rows).select("doc_id", "table_no", "row_no", F.array_join("cells", " | ").alias("cells"))


def page_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as boxes and rules on their suppliers' pages, on a grid that isn't drawn exactly."""
    near = lambda c, k: F.col(c) % k * 0.5
    column, row, kind = F.col("l_partkey") % 6, F.col("l_orderkey") % 40, F.col("l_linenumber") % 3
    x0, top = column * 60 + near("l_partkey", 3), row * 40 + near("l_orderkey", 3)
    x1 = F.when(kind == 1, x0).otherwise(x0 + 60 + near("l_suppkey", 2))
    bottom = F.when(kind == 2, top).otherwise(top + F.when(row % 4 == 3, 30).otherwise(40))
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), x0.cast("double").alias("x0"), top.cast("double").alias("top"), x1.cast("double").alias("x1"), bottom.cast("double").alias("bottom"))


@query()
def ruled_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rulings.ruled_tables(page_strokes(spark, sf_dir))


@query()
def chosen_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as edits of the texts of their suppliers, of three passes."""
    start = F.col("l_orderkey") * 13 % 20_000
    x = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), (F.col("l_linenumber") % 3).alias("priority"), start.alias("start"), (start + F.when(F.col("l_partkey") % 10 == 0, 0).otherwise(F.col("l_quantity").cast("long") * 4)).alias("end"), F.col("l_partkey").cast("string").alias("new"))
    return splices.chosen(x)


PREVIEW_SQL = """
WITH p AS (SELECT c_custkey AS doc_id, '<br>' || c_name || '<BR/>' AS a, c_custkey % 2 = 0 AS video, lpad((c_custkey % 60)::VARCHAR, 2, '0') AS sec, 'a/' || c_custkey % 7 || '.png' AS src FROM customer)
SELECT doc_id, '# ' || doc_id || chr(10) || CASE WHEN video THEN 'https://youtu.be/abcdefghijk ' ELSE '' END || replace(replace(a, '<br>', chr(10)), '<BR/>', chr(10)) || chr(10)
 || '| x' || chr(8232) || 'y | z |' || chr(10) || CASE WHEN video THEN '**[[⏱️ 01:' || sec || ']](yt://abcdefghijk?t=' || (60 + doc_id % 60) || ')**' ELSE '**[01:' || sec || ']**' END || chr(10)
 || '[![pic](' || CASE WHEN doc_id % 7 < 3 THEN 'data:' || src ELSE src END || ')](imgaction://select?src=' || src || '&idx=0&start=' || (length('# ' || doc_id || CASE WHEN video THEN 'https://youtu.be/abcdefghijk ' ELSE '' END || a || '| x<br>y | z |' || '**[01:' || sec || ']**') + 4) || ')' || chr(10)
 || '```' || chr(10) || '![pic](b.png)<br>' || chr(10) || '```' || chr(10) || '![Mermaid Diagram](https://mermaid.ink/img/' || base64(('{"code":"graph ' || doc_id || '"}')::BLOB) || ')' AS text FROM p"""


@query(PREVIEW_SQL)
def previews_spliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown made of every customer, and what is shown of it."""
    key, nl = F.col("c_custkey").cast("string"), F.lit("\n")
    src = F.concat(F.lit("a/"), (F.col("c_custkey") % 7).cast("string"), F.lit(".png"))
    second = F.lpad((F.col("c_custkey") % 60).cast("string"), 2, "0")
    text = F.concat(F.lit("# "), key, nl, F.when(F.col("c_custkey") % 2 == 0, "https://youtu.be/abcdefghijk ").otherwise(""), F.lit("<br>"), "c_name", F.lit("<BR/>\n| x<br>y | z |\n**[01:"), second, F.lit("]**\n![pic]("), src, F.lit(")\n```\n![pic](b.png)<br>\n```\n```mermaid\ngraph "), key, F.lit("\n```"))
    docs = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name")).select(F.col("c_custkey").alias("doc_id"), text.alias("text"))
    assets = table(spark, sf_dir, "nation").where("n_nationkey < 3").select(F.concat(F.lit("a/"), F.col("n_nationkey").cast("string"), F.lit(".png")).alias("src")).withColumn("uri", F.concat(F.lit("data:"), "src"))
    return splices.previews(docs, assets)
