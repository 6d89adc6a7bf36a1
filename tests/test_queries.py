"""Every query with SQL against DuckDB on the smallest tables."""

import hashlib
import html
import math
import re

import duckdb
import plain_pages
import pytest

from folio.queries import ORACLES, QUERIES, page_glyphs, page_strokes

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(spark, name):
    return [r.asDict() for r in spark.read.parquet(f"{DIR}/{name}.parquet").collect()]


def check_inline(spark, got):
    """Segments give the lines again, but for the marks that they stand for."""
    lines = {(r["doc_id"], k): line for r in rows_of(spark, "documents") if r["text"] is not None for k, line in enumerate(r["text"].split("\n"))}
    text: dict = {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["line_no"], r["seg_no"])):
        text[r["doc_id"], r["line_no"]] = text.get((r["doc_id"], r["line_no"]), "") + r["text"]
    for at, line in lines.items():
        if not re.search(r"[*_~`<\[]", line):
            assert text.get(at, "") == line
        elif not re.search(r"[_~`<\[]", line):
            assert text.get(at, "") == re.sub(r"\*(.*?)\*", r"\1", re.sub(r"\*\*(.*?)\*\*", r"\1", re.sub(r"\*\*\*(.*?)\*\*\*", r"\1", line)))


def page_words(page):
    page = re.sub(r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<title\b.*?</title\s*>|<!--.*?-->", " ", page or "")
    page = re.sub(r"(?i)</?(?:p|div|h[1-6]|li|ul|ol|br|article|nav|footer|header|section|body|html|head)\b[^>]*>", "\n", page)
    return re.findall(r"[^\W_]+", html.unescape(re.sub(r"<[^>]*>", "", page)))


def check_pages(spark, got, key="page_id"):
    """The words of each page in their order, without marks and addresses."""
    pages = {str(r["page_id"]): r["html"] for r in rows_of(spark, "pages")}
    assert len(got) == len(pages)
    for r in got:
        text = re.sub(r"\]\([^)]*\)", "", r["text"])
        assert [w for w in re.findall(r"[^\W_]+", text)] == page_words(pages[str(r[key]).removesuffix(".docx")])


def snippets(spark):
    events = rows_of(spark, "events")
    first = min(r["ts"] for r in events)
    out: dict = {}
    for r in events:
        out.setdefault(r["user_id"], []).append(((r["ts"] - first).total_seconds() / 600, r["event_id"], r["event_type"] + ("." if r["event_id"] % 3 == 0 else "")))
    return {m: sorted(x) for m, x in out.items()}


def plain_groups(spark):
    out = {}
    for m, rows in snippets(spark).items():
        groups, held = [], []
        for at, _, text in rows:
            if held and at - held[-1][0] >= 20:
                groups, held = [*groups, held], []
            held.append((at, text))
            lasted = at - held[0][0]
            if lasted >= 15 and text.endswith(".") or lasted >= 30 and len(held) >= 3:
                groups, held = [*groups, held], []
        for k, g in enumerate([*groups, *([held] if held else [])], 1):
            text = " ".join(t for _, t in g)
            text = text if text.endswith(".") else f"{text}."
            out[m, k] = (g[0][0], text[0].upper() + text[1:])
    return out


def check_groups(spark, got):
    want = plain_groups(spark)
    assert {(r["media_id"], r["group_no"]): r["text"] for r in got} == {k: t for k, (_, t) in want.items()}
    assert all(math.isclose(r["start"], want[r["media_id"], r["group_no"]][0], abs_tol=1e-9) for r in got)


def check_transcripts(spark, got):
    groups: dict = {}
    for (m, k), (at, text) in sorted(plain_groups(spark).items()):
        groups.setdefault(m, []).append((at, text))
    assert {r["media_id"] for r in got} == set(groups)
    for r in got:
        m, s = r["media_id"], lambda at: f"{int(at) // 3600:02}:{int(at) % 3600 // 60:02}:{int(at) % 60:02}" if at >= 3600 else f"{int(at) // 60:02}:{int(at) % 60:02}"
        video = hashlib.md5(str(m).encode()).hexdigest()[:11]
        lines = [f"**[[{s(at)}]](yt://{video}?t={int(at)})** {t}" if m % 2 == 0 else f"**[{s(at)}]** {t}" for at, t in groups[m]]
        assert r["text"] == "\n\n".join([f"# Talk {m}", *lines]) and r["n_groups"] == len(lines)


def check_clauses(spark, got):
    rows: dict = {}
    for r in rows_of(spark, "lineitem"):
        rows.setdefault((r["l_suppkey"], r["l_partkey"] % 5), []).append((r["l_orderkey"] * 8 + r["l_linenumber"], int(r["l_quantity"]) if r["l_partkey"] % 7 else None))
    mine: dict = {}
    for r in got:
        mine.setdefault((r["doc_id"], r["article"]), []).append((r["seq"], r["repaired"]))
    for key, of in rows.items():
        if len({s for s, _ in of}) < len(of):
            assert len(mine[key]) == len(of)  # rows of one place come in any order
            continue
        last = 0
        for (seq, n), (mine_seq, fixed) in zip(sorted(of), sorted(mine[key]), strict=True):
            last = last + 1 if n is None or last >= 2 and n <= last else n
            assert (seq, last) == (mine_seq, fixed)


def check_slides(spark, got):
    pages = {(r["doc_id"], r["line_no"]): r["page"] for r in got}
    for r in rows_of(spark, "documents"):
        page, used = 1, 0.0
        for k, line in enumerate((r["text"] or "").split("\n") if r["text"] is not None else []):
            height = round(0.26 * max(1, math.ceil(len(line) / 75)) + 0.18, 2)
            if k and used + height > 5.0:
                page, used = page + 1, 0.0
            used += height
            assert pages[r["doc_id"], k] == page


def check_columns(spark, got):
    """Merging by hand of the cells that md_tables gives."""
    tables: dict = {}
    for r in QUERIES["md_tables"](spark, DIR).collect():
        tables.setdefault((r.doc_id, r.table_no), {}).setdefault(r.row_no, {})[r.col_no] = r.cell
    want = {}
    for key, rows in tables.items():
        columns = [[rows[n][k].strip() for n in sorted(rows)] for k in range(len(next(iter(rows.values()))))]
        while (k := next((k for k in range(len(columns) - 1) if not any(a and b for a, b in zip(columns[k], columns[k + 1], strict=True))), None)) is not None:
            columns[k : k + 2] = [[a + b for a, b in zip(columns[k], columns[k + 1], strict=True)]]
        want |= {(*key, n): len(columns) for n in rows}
    assert {(r["doc_id"], r["table_no"], r["row_no"]): r["n_cells"] for r in got} == want


def glyph_pages(spark):
    by: dict = {}
    for r in page_glyphs(spark, DIR).collect():
        by.setdefault(r["page"], []).append(r.asDict())
    return by


def check_page_texts(spark, got):
    assert {r["page"]: (r["layout"], r["text"]) for r in got} == {p: plain_pages.page_text(g) for p, g in glyph_pages(spark).items()}


def check_glyph_lines(spark, got):
    pages: dict = {}
    for r in rows_of(spark, "lineitem"):
        top = r["l_partkey"] * 7 % 1500 + r["l_linenumber"] * 0.25
        pages.setdefault(r["l_suppkey"], []).append({"glyph_no": (r["l_orderkey"] * 8 + r["l_linenumber"]) * 1_000_000 + r["l_partkey"], "x0": float(r["l_orderkey"] % 500), "top": top, "bottom": top + r["l_quantity"] % 9 + 1})
    mine: dict = {}
    for r in got:
        mine.setdefault((r["page"], r["line_no"]), []).append(r["glyph_no"])
    for p, of in pages.items():
        for k, line in enumerate(plain_pages.lines_of(of), 1):
            assert sorted(mine.pop((p, k))) == sorted(g["glyph_no"] for g in line)
    assert not mine


def check_merged_lines(spark, got):
    mine: dict = {}
    for r in sorted(got, key=lambda r: r["item_no"]):
        mine.setdefault(r["doc_id"], []).append((r["text"], r["level"]))
    for r in rows_of(spark, "documents"):
        items = []
        for line in (r["text"] or "").split("\n"):
            m = re.match(r"(#{1,3}) ", line)
            items.append((line[m.end() :] if m else line, len(m[1]) if m else 0))
        assert mine.get(r["doc_id"], []) == plain_pages.joined(items)


def check_joined_tables(spark, got):
    docs: dict = {}
    for r in rows_of(spark, "lineitem"):
        key, n = r["l_partkey"], int(r["l_quantity"])
        no = (r["l_orderkey"] * 8 + r["l_linenumber"]) * 100_000 + key
        of = docs.setdefault(r["l_suppkey"], {})
        of[no] = (["text", "page_break", "table", "table"][key % 4], r["l_orderkey"] % 200, key % 2 + 2, max(n, of.get(no, (0,) * 4)[3]))
    mine: dict = {}
    for r in sorted(got, key=lambda r: (r["table_no"], r["row_no"])):
        mine.setdefault(r["doc_id"], {}).setdefault(r["table_no"], []).append(r["cells"])
    for d, of in docs.items():
        elements = [(no, kind, chars, cols) for no, (kind, chars, cols, _) in sorted(of.items())]
        columns, rows = {}, {}
        for no, (_, _, cols, q) in of.items():
            shift = [q * (k + 3) % 90 - 45 for k in range(cols)]
            columns[no] = [(k * 100 + s, k * 100 + s + 80) for k, s in enumerate(shift)]
            rows[no] = [["" if (q + row * 7 + k * 5) % 3 == 0 else f"c{q + k}" + "." * ((q + k) % 4 == 0) for k in range(cols)] for row in range(1, q % 3 + 2)]
        want: dict = {}
        for k, cells in plain_pages.joined_tables(elements, columns, rows):
            want.setdefault(k, []).append(" | ".join(cells))
        assert mine[d] == want


def check_ruled_tables(spark, got):
    pages: dict = {}
    for r in page_strokes(spark, DIR).collect():
        pages.setdefault(r["page"], []).append((r["x0"], r["top"], r["x1"], r["bottom"]))
    mine: dict = {}
    for r in got:
        mine.setdefault(r["page"], []).append((r["table_no"], r["row_no"], r["col_no"], *(round(r[c], 6) for c in ("x0", "top", "x1", "bottom"))))
    for p, of in pages.items():
        assert sorted(mine.get(p, [])) == sorted((*c[:3], *(round(x, 6) for x in c[3:])) for c in plain_pages.ruled(of))


def check_chosen_edits(spark, got):
    docs: dict = {}
    for r in rows_of(spark, "lineitem"):
        start = r["l_orderkey"] * 13 % 20_000
        docs.setdefault(r["l_suppkey"], []).append((r["l_linenumber"] % 3, start, start + (0 if r["l_partkey"] % 10 == 0 else int(r["l_quantity"]) * 4), str(r["l_partkey"])))
    mine: dict = {}
    for r in got:
        mine.setdefault(r["doc_id"], []).append((r["priority"], r["start"], r["end"], r["new"]))
    assert {d: sorted(x) for d, x in mine.items()} == {d: sorted(plain_pages.chosen(x)) for d, x in docs.items()}


#: Queries that SQL can't express, held against plain versions.
PLAIN = {"page_texts": check_page_texts, "glyph_lines": check_glyph_lines, "merged_lines": check_merged_lines, "joined_tables": check_joined_tables, "ruled_tables": check_ruled_tables, "chosen_edits": check_chosen_edits, "inline_segments": check_inline, "html_to_md": check_pages, "pages_to_documents": lambda spark, got: check_pages(spark, got, "path"), "transcript_groups": check_groups, "transcript_documents": check_transcripts, "clause_numbers": check_clauses, "slide_pages": check_slides, "merged_columns": check_columns}


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.6g}"
    return None if v is None else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    if name not in ORACLES:
        assert got and name in PLAIN
        PLAIN[name](spark, [r.asDict() for r in QUERIES[name](spark, DIR).collect()])
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    found = con.execute(ORACLES[name])
    at = [[c[0] for c in found.description].index(c) for c in cols]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in found.fetchall())
