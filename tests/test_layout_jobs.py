"""Joined tables, ruled tables, splices, streams with state and the data source."""

import random
import time
from collections import Counter

import plain_pages as plain
import pytest
from pyspark.sql import functions as F

from folio.operators import rulings, splices, tables
from folio.sources import formats
from folio.streaming import progress


@pytest.fixture
def apart(spark):
    """Ranges stay apart, so groups lie in several of them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def some_document(rng, n):
    """Elements, columns and rows of a document."""
    elements, columns, rows = [], {}, {}
    for no in range(n):
        kind = rng.choice(["table", "table", "page_break", "page_break", "text", "image" if rng.random() < 0.2 else "page_break"])
        width = rng.choice([2, 3, 3])
        elements.append((no * 2, kind, rng.choice([5, 80, 149, 200]), width if kind == "table" else None))
        if kind == "table":
            columns[no * 2] = [(k * 100 + rng.randrange(-60, 60), k * 100 + 90 + rng.randrange(-30, 60)) for k in range(width)]
            rows[no * 2] = [[rng.choice(["", "", None, " a ", "b.", "c:", "d"]) for _ in range(width)] for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))]
    return elements, columns, rows


def test_tables_joined_over_pages(spark, apart):
    rng = random.Random(3)
    docs = {k: some_document(rng, 25) for k in range(30)} | {None: some_document(rng, 30), 500: some_document(rng, 900)}
    e = [(d, *x) for d, (of, _, _) in docs.items() for x in of]
    c = [(d, no, k, float(x0), float(x1)) for d, (_, of, _) in docs.items() for no, cols in of.items() for k, (x0, x1) in enumerate(cols)]
    r = [(d, no, k, cells, "x") for d, (_, _, of) in docs.items() for no, many in of.items() for k, cells in enumerate(many)]
    got = {}
    out = tables.joined(
        spark.createDataFrame(e, "doc_id int, elem_no int, type string, n_chars int, n_cols int").repartition(3),
        spark.createDataFrame(c, "doc_id int, elem_no int, col_no int, x0 double, x1 double").repartition(3),
        spark.createDataFrame(r, "doc_id int, elem_no int, row_no int, cells array<string>, table_no string").repartition(3),
    )
    for x in out.orderBy("table_no", "row_no").collect():
        got.setdefault(x["doc_id"], {}).setdefault(x["table_no"], []).append(x["cells"])
    for d, (elements, columns, rows) in docs.items():
        want = {}
        for k, cells in plain.joined_tables(elements, columns, rows):
            want.setdefault(k, []).append(cells)
        assert got.get(d, {}) == want, d
    assert any(len(x) > 3 for of in got.values() for x in of.values())


def some_strokes(rng):
    """A page's grids, some with merged cells, gaps and noise."""
    out, y = [], 20.0
    jitter = lambda: rng.uniform(-1.2, 1.2)
    for _ in range(rng.randrange(1, 4)):
        xs, ys = [40.0 + 70 * k for k in range(rng.randrange(2, 6))], [y + 30 * k for k in range(rng.randrange(2, 5))]
        for yy in ys:
            cut = rng.random() < 0.3
            out.append((xs[0] + jitter(), yy, xs[-2 if cut and len(xs) > 2 else -1] + jitter(), yy))
        for xx in xs:
            for a, b in zip(ys, ys[1:], strict=False):
                if xx in (xs[0], xs[-1]) or rng.random() < 0.8:
                    out.append((xx, a + jitter(), xx, b + jitter()))
        y = ys[-1] + rng.choice([2.0, 25.0, 60.0])
    out += [(rng.random() * 400, y + rng.random() * 100, rng.random() * 400, y + rng.random() * 100) for _ in range(rng.randrange(3))]
    return out


def rounded(rows):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)


def test_ruled_tables_like_all_against_all(spark, apart):
    rng = random.Random(4)
    pages = {p: some_strokes(rng) for p in range(25)}
    pages[99] = [(40.0 + 60 * (k % 7), 30.0 * (k // 7), 100.0 + 60 * (k % 7), 30.0 * (k // 7) + 20) for k in range(350)]  # a hot page of boxes, in many bands
    rows = [(p, *s, 1) for p, of in pages.items() for s in of] + [(None, 1.0, 1.0, 9.0, 1.0, 1), (7, None, 1.0, 2.0, 3.0, 1)]
    df = spark.createDataFrame(rows, "page int, x0 double, top double, x1 double, bottom double, band int").repartition(4)
    cells = rulings.ruled_tables(df)
    got = {}
    for r in cells.collect():
        got.setdefault(r["page"], []).append((r["table_no"], r["row_no"], r["col_no"], r["x0"], r["top"], r["x1"], r["bottom"]))
    for p, of in pages.items():
        assert rounded(got.get(p, [])) == rounded(plain.ruled(of)), p
    assert len({r[0] for r in got[99]}) == 50 and sum(len(x) for x in got.values()) > 450
    words = [(p, k, rng.random() * 400, y := rng.random() * 300, f"w{k}") for p in range(25) for k in range(40)]
    df = spark.createDataFrame([(p, k, x, x + 8, y, y + 8, t) for p, k, x, y, t in words], "page int, word_no int, x0 double, x1 double, top double, bottom double, text string")
    texts = {(r["page"], r["table_no"], r["row_no"], r["col_no"]): r["text"] for r in rulings.cell_texts(cells, df).collect()}
    for p in range(25):
        for t, row, col, x0, top, x1, bottom in got.get(p, []):
            inside = sorted((y + 4, x, k, w) for q, k, x, y, w in words if q == p and x0 <= x + 4 < x1 and top <= y + 4 < bottom)
            assert texts[p, t, row, col] == " ".join(w for *_, w in inside)
    assert rulings.ruled_tables(df.limit(0).select("page", "x0", "top", "x1", "bottom")).count() == 0


def test_splices_like_each_against_all(spark, apart):
    rng = random.Random(5)
    edits, texts = [], {}
    for d in range(40):
        n = rng.choice([0, 5, 40, 20_000])
        texts[d] = "".join(rng.choice("abcé😀\n") for _ in range(n))
        for _ in range(rng.randrange(12) if d else 1500):
            s = rng.randrange(n + 1)
            edits.append((d, rng.randrange(3), s, min(n, s + rng.choice([0, 0, 1, 3, 9, 6000 if n > 9000 else 2])), rng.choice(["X", "", None, "yz"])))
    edits += edits[:20]
    df = spark.createDataFrame([(*e, "x") for e in [*edits, (None, 0, 0, 1, "n"), (1, 0, 3, 2, "turned"), (1, None, 0, 1, "x")]], "doc_id long, priority int, start long, end long, new string, _bin string").repartition(5)
    made = splices.chosen(df)
    got = {}
    for r in made.collect():
        got.setdefault(r["doc_id"], []).append((r["priority"], r["start"], r["end"], r["new"]))
    docs = spark.createDataFrame([*texts.items(), (77, None), (78, "as it is")], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in splices.spliced(docs, made).collect()}
    for d, t in texts.items():
        want = plain.chosen([e[1:] for e in edits if e[0] == d])
        assert sorted(got.get(d, []), key=repr) == sorted(want, key=repr), d
        if not Counter(e[1] for e in want if e[1] == e[2]).most_common(1) or max(Counter(e[1] for e in want if e[1] == e[2]).values(), default=0) < 2:
            assert out[d] == plain.spliced(t, want)
    assert out[77] is None and out[78] == "as it is"


def test_previews_are_put_together_once(spark):
    text = '# T\n**[01:05]** see https://youtu.be/abcdefghijk <br> x\n| a<br>b | c |\n![cat](a/b.png) <img src="z.png" align="center">\n```\n![no](code.png)<br>**[00:01]**\n```\n```mermaid\ngraph <br> A\n```\n**[1:02:03]**(linked) end'
    docs = spark.createDataFrame([(1, text), (2, "**[01:05]** no video, <BR/> a break"), (3, None), (4, "")], "doc_id long, text string")
    assets = spark.createDataFrame([("a/b.png", "data:image/png;base64,AA")], "src string, uri string")
    got = {r["doc_id"]: r["text"] for r in splices.previews(docs, assets).collect()}
    at = text.index("![cat]"), text.index("<img")
    import base64

    drawn = base64.b64encode(b'{"code":"graph <br> A"}').decode()
    assert got[1] == (
        "# T\n**[[⏱️ 01:05]](yt://abcdefghijk?t=65)** see https://youtu.be/abcdefghijk \n x\n| a b | c |\n"
        f"[![cat](data:image/png;base64,AA)](imgaction://select?src=a/b.png&idx=0&start={at[0]}) "
        f'<p align="center">[![image](z.png)](imgaction://select?src=z.png&idx=1&start={at[1]})</p>\n'
        f"```\n![no](code.png)<br>**[00:01]**\n```\n![Mermaid Diagram](https://mermaid.ink/img/{drawn})\n**[1:02:03]**(linked) end"
    )
    assert got[2] == "**[01:05]** no video, \n a break" and got[3] is None and got[4] == ""


# --- streams


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", progress.ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


class Stream:
    """Batches written to a folder, run through a query that begins anew for each."""

    def __init__(self, spark, tmp, schema, job, timers=False):
        self.spark, self.tmp, self.schema, self.job, self.timers, self.n = spark, tmp, schema, job, timers, 0
        (tmp / "in").mkdir()

    def run(self, *rows):
        """What one more batch gives out, after a restart from the checkpoint."""
        self.n += 1
        if rows:
            self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(str(self.tmp / "in"))
        out, name = [], f"b{self.n}"

        def keep(df, _):
            out.extend(map(tuple, df.collect()))

        stream = self.spark.readStream.schema(self.schema).parquet(str(self.tmp / "in"))
        q = self.job(stream).writeStream.queryName(name).foreachBatch(keep).option("checkpointLocation", str(self.tmp / "cp"))
        if not self.timers:
            q.trigger(availableNow=True).start().awaitTermination(60)
            return sorted(out, key=repr)
        q = q.start()  # with timers a query never ends by itself
        try:
            until = time.time() + 60
            while time.time() < until and q.exception() is None and sum(p["numInputRows"] for p in q.recentProgress) < len(rows):
                time.sleep(0.2)
            assert q.exception() is None
        finally:
            q.stop()
        return sorted(out, key=repr)


PAGE = "doc_id string, generation long, page_no int, total int, text string"


def test_pages_are_given_out_once(rocks, tmp_path):
    s = Stream(rocks, tmp_path, PAGE, lambda df: progress.page_progress(df, 3_600_000), timers=True)
    assert s.run(("a", 1, 1, 4, "p1"), ("a", 1, 2, 4, "p2"), ("b", 1, 1, 1, "q1"), (None, 1, 1, 1, "x"), ("c", 1, None, 1, "x")) == [("a", 1, 1, 25, "page", "p1"), ("a", 1, 2, 50, "page", "p2"), ("b", 1, 1, 100, "complete", "q1")]
    # a restart: pages that have been aren't given out again, and go on where it stopped
    assert s.run(("a", 1, 2, 4, "p2"), ("a", 1, 4, 4, "p4"), ("b", 1, 1, 1, "q1")) == [("a", 1, 4, 75, "page", "p4")]
    # a newer load begins anew; the older one's last page comes too late
    assert s.run(("a", 2, 1, 2, "n1")) == [("a", 2, 1, 50, "page", "n1")]
    assert s.run(("a", 1, 3, 4, "p3")) == []
    assert s.run(("a", 2, 2, 2, "n2"), ("a", 2, 1, 2, "n1")) == [("a", 2, 2, 100, "complete", "n2")]


def test_a_load_that_stops_is_told_once(rocks, tmp_path):
    s = Stream(rocks, tmp_path, PAGE, lambda df: progress.page_progress(df, 3000), timers=True)
    got = s.run(("a", 1, 1, 3, "p1"), ("b", 1, 1, 1, "q"))
    time.sleep(3)
    got += s.run(("c", 1, 1, 1, "r"))
    assert sorted(got, key=repr) == [("a", 1, 1, 33, "page", "p1"), ("a", 1, None, 33, "stalled", None), ("b", 1, 1, 100, "complete", "q"), ("c", 1, 1, 100, "complete", "r")]
    assert s.run(("a", 1, 2, 3, "p2"))[0] == ("a", 1, 2, 66, "page", "p2")


def test_segments_say_something_new(rocks, tmp_path):
    s = Stream(rocks, tmp_path, "media_id int, seq long, start double, end double, duration double, text string", progress.segment_progress)
    assert s.run((1, 1, 0.0, 2.0, 8.0, " Hi "), (1, 2, 2.0, 4.0, 8.0, "Hi"), (1, 3, 4.0, 6.0, 8.0, None), (1, 4, 6.0, 9.0, 8.0, "there")) == [(1, 1, 0.0, "Hi", 0.25), (1, 4, 6.0, "there", 1.0)]
    assert s.run((1, 5, 8.0, 9.0, 8.0, "there"), (1, 4, 6.0, 9.0, 8.0, "there"), (2, 1, 0.0, 1.0, 0.0, "no length")) == [(2, 1, 0.0, "no length", None)]


def test_late_loads_are_refused(rocks, tmp_path):
    s = Stream(rocks, tmp_path, "doc_id int, generation long, text string", progress.latest_loads)
    assert s.run((1, 2, "b"), (1, 1, "a"), (2, 5, "x"), (None, 1, "n")) == [(1, 2, "b"), (2, 5, "x")]
    assert s.run((1, 1, "late"), (1, 2, "same"), (2, 7, "z"), (2, 6, "y")) == [(2, 7, "z")]
    assert s.run((2, 6, "y"), (1, 3, "c")) == [(1, 3, "c")]


def test_sessions_of_events(spark, tmp_path):
    from folio.streaming.jobs import sessions

    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:04:00"), (1, "2024-01-01 01:00:00"), (2, "2024-01-01 00:00:00")]
    x = spark.createDataFrame(rows, "user int, at string").withColumn("at", F.to_timestamp("at"))
    got = sorted((r["user"], r["n"], str(r["ends"] - r["begins"])) for r in sessions(x, "user", "at", "5 minutes", "1 hour").collect())
    assert got == [(1, 1, "0:05:00"), (1, 2, "0:09:00"), (2, 1, "0:05:00")]


# --- data source


def test_documents_as_a_format(spark, tmp_path):
    formats.registered(spark)
    top = tmp_path / "docs"
    rows = [(f"d{k}/f{k}.md", f"# Doc {k}".encode()) for k in range(6)] + [("t.csv", b"a,b\n1,2\n"), ("bad.xlsx", b"no zip"), ("skip.bin", b"x"), ("_hidden.md", b"h")]
    spark.createDataFrame(rows, "path string, content binary").repartition(3).write.format("folio").option("path", str(top)).mode("append").save()
    assert sorted(p.relative_to(top).as_posix() for p in top.rglob("*") if p.is_file()) == sorted(p for p, _ in rows)
    read = lambda **o: spark.read.format("folio").option("path", str(top)).options(**o).load()
    got = {r["path"].removeprefix(f"{top}/"): (r["text"], r["error"]) for r in read().collect()}
    assert set(got) == {p for p, _ in rows if not p.endswith(".bin") and not p.startswith("_")}
    assert got["d3/f3.md"] == ("# Doc 3", None) and got["t.csv"][0].startswith("| a") and got["bad.xlsx"][0] is None and "BadZipFile" in got["bad.xlsx"][1]
    assert read(format="csv").count() == 1 and read(taskBytes="10").rdd.getNumPartitions() > 3
    # conditions on the path are used before a file is opened
    one = read().where(F.col("path").endswith("f2.md"))
    assert [r["text"] for r in one.collect()] == ["# Doc 2"]
    reader = formats.DocumentReader({"path": str(top)}, ["path", "text", "error"], formats.registry)
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith

    left = list(reader.pushFilters([EqualTo(("path",), f"{top}/t.csv"), GreaterThan(("path",), "a"), EqualTo(("text",), "x")]))
    assert len(left) == 2 and [p.paths for p in reader.partitions()] == [[f"{top}/t.csv"]]
    reader = formats.DocumentReader({"path": str(top)}, ["path"], formats.registry)
    assert not list(reader.pushFilters([StringStartsWith(("path",), f"{top}/d"), In(("path",), (f"{top}/d1/f1.md", f"{top}/t.csv"))]))
    assert [list(reader.read(p)) for p in reader.partitions()] == [[(f"{top}/d1/f1.md",)]]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    formats.registered(spark)
    top = tmp_path / "out"
    put = lambda rows, mode="append": spark.createDataFrame(rows, "path string, content string").repartition(2).write.format("folio").option("path", str(top)).mode(mode).save()
    put([("a.md", "one")])
    for bad in ([("b.md", "x"), ("../c.md", "y")], [("b.md", "x"), ("b.md", "y")], [("b.md", "x"), ("a.md", "y")]):
        with pytest.raises(Exception, match="path|exist|Exists|a.md"):
            put(bad)
        assert [p.name for p in top.rglob("*")] == ["a.md"] and (top / "a.md").read_text() == "one"
    put([("a.md", "two")], "overwrite")
    assert (top / "a.md").read_text() == "two"
    with pytest.raises(Exception, match="content"):
        spark.range(2).write.format("folio").option("path", str(top)).mode("append").save()


def test_a_format_of_ones_own(spark, tmp_path):
    own = formats.Registry()
    own.register("shout", [".shout"], lambda raw: raw.decode().upper())
    formats.registered(spark, own)
    (tmp_path / "x.shout").write_text("hey")
    assert [r["text"] for r in spark.read.format("folio").option("path", str(tmp_path)).option("format", "shout").load().collect()] == ["HEY"]
    assert own.of("/a/B.SHOUT") is not None and own.of("/a/b") is None and formats.registry.of("/a/b.shout") is None
    formats.registered(spark)
    assert spark.read.format("folio").option("path", str(tmp_path)).load().count() == 0
