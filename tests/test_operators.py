"""Operators on small inline inputs."""

import io
import random
import zipfile
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from folio import queries, runtime
from folio.functions import text as T
from folio.functions.html import page_markdown
from folio.functions.inline import segments_of
from folio.functions.tree import from_markdown, to_markdown, yaml_text, yaml_value
from folio.operators import catalog, images, layout, lines, preview, ranks, search, tables, transcript, workspace
from folio.plans import convert
from folio.sources import files
from folio.streaming import jobs


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def test_tables_are_found_named_and_padded(spark):
    rows = tables.table_lines(lines.lines(docs(spark, "# A/b?\n\n| x | y |\n|---|---|\n| 1 |\n\ntext\n| lone |", "a | b\nc | d", None, "")))
    got = {(r.doc_id, r.table_no, r.row_no): (r.table_name, r.cells) for r in rows.collect()}
    assert got == {(0, 1, 1): ("A_b_", ["x", "y"]), (0, 1, 2): ("A_b_", ["1", ""]), (1, 1, 1): ("Sheet1", ["a", "b"]), (1, 1, 2): ("Sheet1", ["c", "d"])}


def test_escaped_pipes_survive_a_round_trip(spark):
    x = spark.createDataFrame([(1, 1, "a|b", "c\nd"), (1, 2, "", "-")], "k int, i int, p string, q string")
    text = tables.rendered(x, ["k"], ["i"], ["p", "q"])
    rows = tables.table_lines(lines.lines(text, "k"), compat=False).orderBy("row_no").collect()
    assert [r.cells for r in rows] == [["p", "q"], ["a|b", "c<br>d"], ["", "-"]]


def test_table_warnings(spark):
    found = tables.table_warnings(lines.lines(docs(spark, "| a | b |\n|---|---|\n| 1 |", "| a |", "a|b\nc|d"))).collect()
    assert {(r.doc_id, r.line_no, r.warning) for r in found} == {(0, 2, "columns"), (1, 0, "incomplete"), (2, 1, "separator")}


def test_inline_segments_nest():
    got = [(s["text"], s["bold"], s["italic"], s["url"], s["is_image"]) for s in segments_of("a **b *c*** ![i](u) [l](v) ~~x~~")]
    assert got[0] == ("a ", False, False, None, False) and ("i", False, False, "u", True) in got and ("l", False, False, "v", False) in got
    assert "".join(s["text"] for s in segments_of("a ** b")) == "a  b"  # an empty italic
    assert segments_of("") == []


@pytest.mark.parametrize(
    "tree",
    [{"title": "T", "settings": {"theme": "dark", "size": 14}}, [{"name": "Alice", "age": 25}, {"name": "Bob", "age": 30}], {"a": {"b": {"c": [1, 2.5, True, None]}}}, {"v": "1.6.3", "d": "2024-01-02", "n": None, "multi": "a\nb\tc"}, ["x", "y"]],
)
def test_trees_come_back(tree):
    assert from_markdown(to_markdown(tree)) == tree


def test_fenced_json_wins():
    assert from_markdown('text\n```json\n{"app": 1, "version": "1.6.3"}\n```') == {"app": 1, "version": "1.6.3"}


def test_html_with_unclosed_tags():
    md = page_markdown('<head><title>t</title><script>var t="</p>"</script></head><h1>Hi</h1><p><b>x<p>y &amp; z<ul><li>a<ul><li>b</ul></ul><table><tr><th>h|i<tr><td>1</table>')
    assert "# Hi" in md and "**x**" in md and "y & z" in md and "- a\n  - b" in md and "var t" not in md


def test_timestamps_and_ids(spark):
    x = spark.createDataFrame([(0,), (59,), (75,), (3665,), (400000,)], "s int").select(T.timestamp_text(F.col("s")).alias("t"))
    assert [r.t for r in x.collect()] == ["00:00", "00:59", "01:15", "01:01:05", "111:06:40"]
    u = ["https://www.youtube.com/watch?v=abcdefghijk", "https://youtu.be/abcdefghijk?t=3", "https://www.youtube.com/shorts/abcdefghijk", "abcdefghijk", "https://x.org/watch?v=abcdefghijk", "short"]
    got = [r.v for r in spark.createDataFrame([(x,) for x in u], "u string").select(T.video_id(F.col("u")).alias("v")).collect()]
    assert got == ["abcdefghijk"] * 4 + [None, None]


def test_scalars_keep_their_kind(spark):
    x = spark.createDataFrame([("True",), ("~",), ("007",), ("1.50",), ("1e5",), ("10.0.0.1",), ("[1]",), ("a\\nb",)], "x string").select(T.coerced(F.col("x")).alias("c"))
    assert [(r.c.kind, r.c.value) for r in x.collect()] == [("boolean", "true"), ("null", None), ("integer", "7"), ("float", "1.50"), ("string", "1e5"), ("string", "10.0.0.1"), ("json", "[1]"), ("string", "a\nb")]


def test_sentence_groups(spark):
    said = ["Hello", "there", "this is", "a test", "of the", "groups", "and it ends.", "After a pause"]
    at = [0.0, 2.0, 4.0, 6.0, 8.0, 10.0, 16.0, 30.0]
    x = spark.createDataFrame([(1, i, s, t) for i, (s, t) in enumerate(zip(at, said, strict=True))] + [(2, 0, 5.0, None), (2, 1, 6.0, "&amp; so,")], "media_id int, seq int, start double, text string")
    got = sorted(map(tuple, transcript.sentence_groups(x, pause=5.0).collect()))
    assert got == [(1, 1, 0.0, "Hello there this is a test of the groups."), (1, 2, 16.0, "And it ends."), (1, 3, 30.0, "After a pause."), (2, 1, 6.0, "& so.")]


def test_ocr_layout(spark):
    t = [(1, 1, 1, 1, "CỘNG", 90), (1, 1, 1, 2, "HÒA", 90), (2, 1, 1, 1, "HỘI", 90), (2, 1, 1, 2, "x", 3), (2, 1, 1, 3, "1.", 8)]
    x = spark.createDataFrame([(0, *r) for r in t], "page int, block int, par int, line int, word int, text string, conf int")
    got = [(r.text, r.gap) for r in layout.ocr_lines(layout.confident(x)).orderBy("block").collect()]
    assert got == [("CỘNG HÒA", False), ("HỘI 1.", True)]


def test_legal_text(spark):
    x = spark.createDataFrame([(0, i, s) for i, s in enumerate(["Chương Ï", "NHỮNG QUY ĐỊNH CHUNG", "Điều 1. Phạm vi", "a) điểm"])], "doc_id int, seq int, line string")
    got = [r.markdown for r in layout.legal_lines(x).orderBy("seq").collect()]
    assert got == ["# Chương I: NHỮNG QUY ĐỊNH CHUNG", "### Điều 1. Phạm vi", "- a) điểm"]


def test_clauses_are_repaired(spark):
    x = spark.createDataFrame([(0, 0, i, n) for i, n in enumerate([1, 2, 3, None, 5, 2])], "doc_id int, article int, seq int, number int")
    assert [r.repaired for r in layout.clause_numbers(x).orderBy("seq").collect()] == [1, 2, 3, 4, 5, 6]


def test_glyphs_stand_on_lines(spark):
    x = spark.createDataFrame([(1, i, float(i), float(t), t + 10.0) for i, t in enumerate([0, 1, 20, 21, 2])], "page int, glyph_no int, x0 double, top double, bottom double")
    assert {r.glyph_no: r.line_no for r in layout.line_clusters(x).collect()} == {0: 1, 1: 1, 4: 1, 2: 2, 3: 2}


def test_image_tokens_and_links(spark):
    text = 'Here is an image: ![Diagram](assets/chart.png) and ![a (b)](p(1)/q.png "t") <img src="x" width="25%"> <p align="center"><img src="z.png"></p>'
    found = images.tokens_of(text)
    assert [(t["start"], t["end"]) for t in found[:1]] == [(18, 46)]
    assert [t["src"] for t in found] == ["assets/chart.png", "p(1)/q.png", "x", "z.png"] and [t["width"] for t in found] == ["", "", "25%", ""] and found[3]["align"] == "center"
    d = docs(spark, text, "none", None)
    out = images.relinked(d, images.image_tokens(d), spark.createDataFrame([("x", "new.png"), ("z.png", "zz.png")], "src string, path string")).orderBy("doc_id").collect()
    assert out[0].text == text.replace('"x"', '"new.png"').replace("z.png", "zz.png") and out[1].text == "none" and out[2].text is None
    twins = docs(spark, '![x](x) <img alt="x" src=\'x\'> ![x](<x> "x")')
    out = images.relinked(twins, images.image_tokens(twins), spark.createDataFrame([("x", "new.png")], "src string, path string")).first().text
    assert out == '![x](new.png) <img alt="x" src=\'new.png\'> ![x](<new.png> "x")'
    assert images.token_at(images.image_tokens(d), 20, 21).collect()[0].token_no == 0


def test_search_and_replace(spark):
    d = docs(spark, "aXa\nbXXb X", "none", None)
    got = [(r.hit_no, r.start, r.end, r.line_no) for r in search.hits(d, "x", case=False).orderBy("hit_no").collect()]
    assert got == [(1, 1, 2, 0), (2, 5, 6, 1), (3, 6, 7, 1), (4, 9, 10, 1)]
    assert [(r.next_no, r.prev_no) for r in search.neighbours(search.hits(d, "X")).orderBy("hit_no").collect()] == [(2, 4), (3, 1), (4, 2), (1, 3)]
    assert search.replaced(d, "X", "$1\\").first().text == "a$1\\a\nb$1\\$1\\b $1\\"


def test_destinations_like_a_loop(spark):
    rng = random.Random(3)
    jobs_ = [(i, f"d/{rng.choice('abc')}{rng.choice(['.md', '.csv', '.docx'])}") for i in range(60)]
    got = {r.scan_no: r.output for r in catalog.destinations(spark.createDataFrame(jobs_, "scan_no int, path string"), ".md").collect()}
    stems = [p.rsplit(".", 1)[0] for _, p in jobs_]
    used: set = set()
    for (i, p), stem in zip(jobs_, stems, strict=True):
        ext, want = p.rsplit(".", 1)[1], f"{stem}.md"
        if stems.count(stem) > 1 and not (ext == "md" and want not in used):
            want, k = f"{stem} ({ext}).md", 0
            while want in used:
                k += 1
                want = f"{stem} ({ext}_{k}).md"
        used.add(want)
        assert got[i] == want


def test_eviction_and_recency(spark):
    s = spark.createDataFrame([("s", i, i, 10, i == 0) for i in range(6)], "store string, session int, mtime int, size int, protected boolean")
    assert sorted(r.session for r in catalog.evicted(s, 35).collect()) == [1, 2, 3]
    e = spark.createDataFrame([("u", "doc1", 1, "a", False), ("u", "doc2", 2, "b", False), ("u", "doc1", 3, "", False), ("u", "doc3", 4, "c", False), ("u", "doc2", 2, "b", True)], "owner string, item string, at int, mode string, pinned boolean")
    assert [(r.item, r["mode"]) for r in catalog.recent(e, 2).orderBy("place").collect()] == [("doc2", "b"), ("doc3", "c")]


def test_slides_and_fences(spark):
    d = docs(spark, "# a\nx\n\n---\n\n## b\n```\n# no\n```", "# a\nx\n# b\ny")
    got = {(r.doc_id, r.slide_no): r.n for r in lines.slides(lines.fenced(lines.lines(d))).groupBy("doc_id", "slide_no").agg(F.count("*").alias("n")).collect()}
    assert got == {(0, 1): 3, (0, 2): 5, (1, 1): 2, (1, 2): 2}


def test_archives_are_guarded(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("notes/intro.md", "hi")
        z.writestr("../evil.md", "x")
    x = spark.createDataFrame([("a.zip", bytearray(out.getvalue())), ("b.zip", bytearray(b"junk"))], "path string, content binary")
    got = {(r.archive, r.path): (r.error is None, r.content) for r in files.entries(x).collect()}
    assert got["a.zip", "notes/intro.md"] == (True, bytearray(b"hi")) and not got["a.zip", "../evil.md"][0] and not got["b.zip", None][0]


def test_batch_isolates_bad_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\n\n| x | y |\n| --- | --- |\n| 1 | =2 |\n")
    (tmp_path / "b.csv").write_bytes("﻿n,v\nq,1\n".encode())
    (tmp_path / "c.docx").write_bytes(b"broken")
    (tmp_path / "d.json").write_text("{bad")
    for ext in (".md", ".xlsx", ".docx", ".html", ".csv", ".json", ".yaml"):
        got = {r.path.rsplit("/")[-1]: r for r in convert.converted(files.files(spark, str(tmp_path)), ext).collect()}
        assert {k: r.status for k, r in got.items() if not k.endswith(ext)} == {k: v for k, v in {"a.md": "success", "b.csv": "success", "c.docx": "failed", "d.json": "failed"}.items() if not k.endswith(ext)}
    book = convert.converted(files.files(spark, str(tmp_path)), ".xlsx").where("path like '%a.md'")
    cells = {(r.row_no, r.col_no): r.cell for r in files.workbook_cells(book.select("path", "content")).collect()}
    assert cells[0, 0] == "A" and cells[3, 1] == "'=2"


RICH = "# Title\n\ntext **bold** and *it* ~~no~~ <u>un</u> `x = 1` [site](http://x/y)\n\n## Part\n\n- one\n- two\n\n1. first\n\n| a\\|b | c |\n| --- | --- |\n| **1** | 2 |\n\n```py\ny < 2\n```\n\n> said\n\n---\n\nend"


def test_documents_keep_their_structure(spark):
    d = spark.createDataFrame([("a.md", RICH), ("b.md", "# T\ntext"), ("c.md", "")], "path string, text string")
    made = convert.exported(d, ".docx").selectExpr("replace(path, '.md', '.docx') AS path", "content")
    got = {r.path: r.text for r in files.imported(made).collect()}
    assert got["b.docx"] == "# T\n\ntext" and got["c.docx"] == ""
    for line in ("# Title", "text **bold** and *it* ~~no~~ <u>un</u> `x = 1` [site](http://x/y)", "## Part", "- one\n- two", "1. first", "| a\\|b | c |\n| --- | --- |\n| **1** | 2 |", "```\ny < 2\n```", "---", "end"):
        assert line in got["a.docx"], line


def test_pages_keep_their_structure(spark):
    d = spark.createDataFrame([("a.md", RICH), ("b.md", "- x\n  - y\n1. z\n<b>&")], "path string, text string")
    page = {r.path: bytes(r.content).decode() for r in convert.exported(d, ".html").collect()}
    a = page["a.md"]
    assert "<ul>\n<li>one</li>\n<li>two</li>\n</ul>" in a and "<ol>\n<li>first</li>\n</ol>" in a
    assert "<table>\n<tr><th>a|b</th><th>c</th></tr>\n<tr><td><strong>1</strong></td><td>2</td></tr>\n</table>" in a
    assert "<pre><code>y &lt; 2</code></pre>" in a and "<blockquote>\nsaid\n</blockquote>" in a and '<a href="http://x/y">site</a>' in a and "<u>un</u>" in a
    assert '<li style="margin-left: 2em">y</li>\n</ul>\n<ol>' in page["b.md"] and "&lt;b&gt;&amp;" in page["b.md"]
    back = page_markdown(a)
    assert "| a\\|b | c |\n| --- | --- |\n| **1** | 2 |" in back and "# Title" in back and "- one\n- two" in back


def test_slides_are_written_in_pages(spark):
    rows = "\n".join(f"| r{i} | {i} |" for i in range(30))
    text = f"# Deck\n\n- **one**\n  - two\n1. three\n\n### Notes:\nsay this\n\n---\n\n## Table\n\n| k | v |\n| --- | --- |\n{rows}\n\n---\n\n## Long\n\n" + "\n".join(f"- item {i}" for i in range(40))
    d = spark.createDataFrame([("a.pptx", text), ("b.pptx", "# T\nx\ny\n## U\nz"), ("c.pptx", "")], "path string, text string")
    got = {r.path: r.text.split("\n\n---\n\n") for r in files.imported(convert.exported(d, ".pptx")).collect()}
    a = got["a.pptx"]
    assert a[0] == "## Deck\n\n- one\n  - two\n1. three\n\n### Notes:\nsay this"
    tables_ = [x for x in a if x.startswith("## Table")]
    assert len(tables_) == 3 and tables_[1].startswith("## Table (Cont.)") and all("| k | v |\n| --- | --- |" in x for x in tables_)
    assert [f"| r{i} | {i} |" for i in range(30)] == [y for x in tables_ for y in x.split("\n") if y.startswith("| r")]
    long = [x for x in a if x.startswith("## Long")]
    assert len(long) > 1 and [y for x in long for y in x.split("\n") if y.startswith("- ")] == [f"- item {i}" for i in range(40)]
    assert got["b.pptx"] == ["## T\n\n- x\n- y", "## U\n\n- z"] and got["c.pptx"] == [""]


def test_headings_with_little_above_divide_nothing(spark):
    d = docs(spark, "# a\n# b\nx\n# c\n### Notes:\nn\n```\n# no\n```\n# d")
    x = lines.slides(lines.fenced(lines.lines(d))).orderBy("line_no").collect()
    assert [r.slide_no for r in x] == [1, 1, 1, 2, 2, 2, 2, 2, 2, 3]


def test_a_batch_is_packed(spark):
    x = spark.createDataFrame([(1, "b/x.md", bytearray(b"x")), (1, "a.md", bytearray(b"a")), (2, "c.md", None), (2, "d.md", bytearray(b"d"))], "batch int, output string, content binary")
    got = {r.batch: zipfile.ZipFile(io.BytesIO(bytes(r.content))) for r in convert.packaged(x).collect()}
    assert got[1].namelist() == ["a.md", "b/x.md"] and got[1].read("b/x.md") == b"x" and got[2].namelist() == ["d.md"]


def test_checks_find_broken_contents(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", "x" * 9000)
    good = out.getvalue()
    bad = good[:60] + bytes([good[60] ^ 255]) + good[61:]
    cases = [("a.xlsx", good, None), ("b.xlsx", bad, "broken"), ("c.docx", good, "member"), ("d.json", b'{"x": 1}', None), ("e.json", b"{broken json", "broken"), ("f.yaml", b"a: [1, 2", "broken"), ("g.md", ("é" * 5000).encode(), None), ("h.md", ("x" + "é" * 5000).encode(), None), ("i.md", b"ok\xff", "encoding"), ("j.json", b"\xff", "broken")]
    x = spark.createDataFrame([(p, len(c), bytearray(c)) for p, c, _ in cases], "path string, length long, content binary")
    assert {r.path: r.problem for r in catalog.checked(x).collect()} == {p: w for p, _, w in cases}


def test_models_that_suit_machines(spark):
    cases = [(32.0, 20.0, 16, True, 12288.0, 11000.0, "whisper-large-v3"), (16.0, 8.0, 6, True, 4096.0, 2000.0, "whisper-small"), (15.39, 6.5, 12, False, 0.0, 0.0, "whisper-small"), (64.0, 40.0, 32, False, 0.0, 0.0, "whisper-small"), (4.0, 1.0, 2, False, 0.0, 0.0, "whisper-base")]
    x = spark.createDataFrame([c[:6] for c in cases], "ram_total_gb double, ram_free_gb double, cores int, cuda boolean, vram_total_mb double, vram_free_mb double")
    assert [r.model for r in catalog.recommended(x).collect()] == [c[6] for c in cases]


def test_scans_keep_build_folders(spark):
    paths = ["build/a.md", "dist/b.csv", "bin/c.md", "$RECYCLE.BIN/d.md", "System Volume Information/e.md", ".venv/f.md", "x/.hidden.md", "Node_Modules/g.md"]
    x = spark.createDataFrame([(p,) for p in paths], "path string")
    assert sorted(r.path for r in catalog.readable(x, catalog.registry(spark)).collect()) == ["bin/c.md", "build/a.md", "dist/b.csv"]


def test_ranks_of_hot_groups(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", None, "b"]), rng.randrange(50), i, rng.randrange(9)) for i in range(400)]
    got = ranks.running(spark.createDataFrame(rows, "g string, t int, i int, v int").repartition(5), ["g"], ["t", "i"], F.col("v")).collect()
    for g in ("a", "b", None):
        want, ahead = sorted(r for r in rows if r[0] == g) if g else sorted((r for r in rows if r[0] is None), key=lambda r: r[1:]), 0
        mine = {r.i: (r.place, r.ahead) for r in got if r.g == g}
        for k, r in enumerate(want, 1):
            assert mine[r[2]] == (k, ahead)
            ahead += r[3]


def test_shared_folder_is_never_guessed_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return {"spark.sql.warehouse.dir": "/w"}.get(key, default)

    session = lambda master: SimpleNamespace(conf=Conf(), sparkContext=SimpleNamespace(master=master))
    assert runtime.shared_dir(session("local[4]")) == "/w/.scratch"
    with pytest.raises(ValueError):
        runtime.shared_dir(session("spark://host:7077"))


def test_image_marks_and_tags_in_any_case():
    got = [(s["text"], s["url"], s["is_image"], s["underline"]) for s in segments_of("![a](pic (1).png) <U>b</u> [![c](d.png)](http://e)")]
    assert got == [("a", "pic (1).png", True, False), (" ", None, False, False), ("b", None, False, True), (" ", None, False, False), ("![c", "d.png", False, False), ("](http://e)", None, False, False)]


def test_offsets_in_utf16_units(spark):
    x = spark.createDataFrame([("a😀b\r\nc",)], "t string")
    got = [x.select(workspace.utf16_offset(F.col("t"), F.lit(k)).alias("n")).first().n for k in range(6)]
    assert got == [0, 1, 3, 4, 6, 7]


def test_files_arrive_as_a_stream(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A")
    (tmp_path / "b.csv").write_text("x,y\n1,2\n")
    q = jobs.arriving(spark, str(tmp_path)).writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert {r.path.rsplit("/")[-1]: r.text for r in spark.table("arrived").collect()} == {"a.md": "# A", "b.csv": "| x | y |\n| --- | --- |\n| 1 | 2 |"}


def test_groups_of_a_stream(spark, tmp_path):
    x = spark.createDataFrame([(1, i, float(2 * i), f"w{i}" + ("." if i == 8 else "")) for i in range(10)], "media_id int, seq int, start double, text string")
    x.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(x.schema).parquet(str(tmp_path / "in"))
    q = jobs.growing_groups(s).writeStream.format("memory").queryName("grown").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert [(r.start, r.text) for r in spark.table("grown").collect()] == [(0.0, "W0 w1 w2 w3 w4 w5 w6 w7 w8.")]


def test_previews(spark):
    d = docs(spark, "see https://youtu.be/abcdefghijk\n**[01:15]** Hi<br>there\n| a<br>b |\n```\nx<br>y\n```", "**[01:15]** no video")
    x = preview.stamps_linked(preview.breaks_shown(lines.fenced(lines.lines(d))))
    got = [r.line for r in x.where("doc_id = 0").orderBy("line_no").collect()]
    assert got[1:3] == ["**[[01:15]](yt://abcdefghijk?t=75)** Hi\nthere", "| a b |"] and got[4] == "x<br>y"
    assert x.where("doc_id = 1").first().line == "**[01:15]** no video"
    assert preview.video_and_title(docs(spark, "# T\nhttps://youtu.be/abcdefghijk")).first()[1:] == ("abcdefghijk", "T")


def test_fences_are_closed(spark):
    d = docs(spark, "```py x = 1\ny\n\n# Head\ntext", "``` a ```\nb", "plain", None)
    got = [r.text for r in preview.fences_repaired(d).orderBy("doc_id").collect()]
    assert got[0] == "```py\nx = 1\ny\n\n```\n\n# Head\ntext" and got[1].split("\n") == ["```", "a", "```", "b"] and got[2:] == ["plain", None]


def test_columns_that_never_meet_are_merged(spark):
    x = spark.createDataFrame([(0, 1, 1, ["a", "", "x"]), (0, 1, 2, ["", "b", "y"]), (0, 1, 3, ["c", "", ""])], "doc_id int, table_no int, row_no int, cells array<string>")
    assert [r.cells for r in preview.merged_columns(x).orderBy("row_no").collect()] == [["a", "x"], ["b", "y"], ["c", ""]]


def test_pages_of_slides(spark):
    x = spark.createDataFrame([(0, 1, i, 2.0) for i in range(5)], "doc_id int, slide_no int, line_no int, height double")
    assert [r.page for r in preview.slide_pages(x).orderBy("line_no").collect()] == [1, 1, 2, 2, 3]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_and_files_are_not_broadcast(spark):
    """What Spark takes for small, as it can't tell how many lines a text has or how
    long a written file is, doesn't go through the driver."""
    docs = spark.createDataFrame([(1, "# a\n\n---\n\nb"), (2, "# a\nx\n## b\ny"), (None, "# c\nx\n## d\ny")], "doc_id long, text string")
    x = lines.slides(lines.fenced(lines.lines(docs)))
    assert "Broadcast" not in plan(x)
    assert sorted([(r.doc_id or 0, r.line_no, r.slide_no) for r in x.collect()]) == [(0, 0, 1), (0, 1, 1), (0, 2, 2), (0, 3, 2), (1, 0, 1), (1, 1, 1), (1, 3, 2), (1, 4, 2), (2, 0, 1), (2, 1, 1), (2, 2, 2), (2, 3, 2)]
    assert "Broadcast" not in plan(convert.exported(docs.select(F.col("doc_id").cast("string").alias("path"), "text"), ".pptx"))
    found = docs.where("doc_id > 0").select(F.concat(F.lit("in/"), "doc_id", F.lit(".md")).alias("path"), F.lit(9).cast("long").alias("length"), F.col("text").cast("binary").alias("content"))
    for ext in (".xlsx", ".pptx"):
        made = convert.converted(found, ext)
        assert "Broadcast" not in plan(made)
        assert sorted((r.path, r.output, r.status, r.content[:2]) for r in made.collect()) == [(f"in/{k}.md", f"in/{k}{ext}", "success", b"PK") for k in (1, 2)]


def test_small_files_that_make_much_work_are_spread(spark, tmp_path):
    """A small table is read in one task; what it is made into isn't worked out in that one."""
    import __spark_entry__ as entry

    for name, key in (("part", "p_partkey"), ("customer", "c_custkey")):
        spark.range(1000).selectExpr(f"id as {key}", "concat('n', id) as p_name", "concat('n', id) as c_name", "id % 25 as c_nationkey").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([(1,)], "n_nationkey long").write.parquet(f"{tmp_path}/nation.parquet")
    made = {"files_converted": queries.customer_files}  # it writes in between, so its files' own plan tells
    for name in ("table_guards", "styled_segments", "trees_exported", "files_converted", "slides", "slides_written", "previews_spliced"):
        assert "REPARTITION_BY_NUM" in plan(made.get(name, entry.queries().get(name))(spark, str(tmp_path))), name


def test_compiled_yaml_gives_what_the_plain_one_does():
    import yaml

    for text in ("name: a\nkey: 1\n", "a: 'x\ty'", "k:\tv", "!", "x: !", ">#|[", "|#b\n  c", "- [1, 2", "é: ü", "d: 2020-01-01", "on: yes"):
        try:
            want = yaml.safe_load(text)
        except yaml.YAMLError as e:
            with pytest.raises(yaml.YAMLError) as found:
                yaml_value(text)
            assert str(found.value) == str(e)
        else:
            assert yaml_value(text) == want
    for value in ({"a": "b c " * 40, "n": [1, None, "- x", "a: b", "#"]}, "word", 1, ["é", "😀"], {"on": "yes", "": []}, {"k" * 127: 1}, {"k" * 128: [{}]}):
        assert yaml_text(value) == yaml.safe_dump(value, sort_keys=False, allow_unicode=True)
