"""What queries do once, and what they don't write, however large the tables are."""

import random

from pyspark.sql import functions as F

from folio.operators import layout, pages, ranks, rulings, workspace
from folio.queries import QUERIES
from folio.runtime import Scratch


def saved(monkeypatch):
    """The columns of each table that is written from now on."""
    found, save = {}, Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: found.update({name: df.columns}) or save(self, df, name))
    return found


def test_a_page_head_is_looked_for_once(spark):
    texts = ["### TOP NEWS", "7", *["7" if k % 40 == 39 else f" text {k}" for k in range(200)], "# late"]
    df = spark.createDataFrame([(texts,), (["a", "# T", "**7**", "7", "8", ""],), ([],), (None,)], "t array<string>").select(workspace.header_first(F.col("t")).alias("t"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    assert [r.t for r in df.collect()] == [["### TOP NEWS", "**7**", *[f"text {k}" for k in range(200) if k % 40 != 39], "# late"], ["**7**", "# T", "a", "8"], [], None]


def test_page_texts_write_no_glyphs(spark, monkeypatch):
    rows = [(k % 3, k, k % 7 * 40.0, k % 7 * 40.0 + 30, k // 21 * 20.0, k // 21 * 20.0 + 9, f"w{k}", 9.0, k % 5 == 0, False) for k in range(200)]
    found = saved(monkeypatch)
    df = spark.createDataFrame(rows, "page int, glyph_no int, x0 double, x1 double, top double, bottom double, text string, size double, bold boolean, italic boolean")
    assert pages.page_texts(df).count() == 3
    assert found and not any("glyph_no" in columns for columns in found.values())


def test_lines_of_repeated_heights(spark, monkeypatch):
    """Glyphs of one height go through the open lines once, not one by one."""
    rng, seen, on_lines = random.Random(7), [], layout._on_lines
    heights = [(top := rng.randint(0, 60), top + rng.choice([1, 5, 9, 30])) for _ in range(25)]
    glyphs = sorted((rng.choice(heights) for _ in range(600)), key=lambda g: g[0] + g[1])
    plain = [(None, 1, (a + b) / 2, None, None, k, a, b, 30) for k, (a, b) in enumerate(glyphs)]
    want = [line for *_, line in on_lines(iter(plain))]
    monkeypatch.setattr(layout, "_on_lines", lambda rows: on_lines(seen.append(r) or r for r in rows))
    got = [line for (line,) in layout._on_page([(float(a), float(b)) for a, b in glyphs])]
    assert len(seen) < 600
    assert [list(dict.fromkeys(got)).index(x) for x in got] == [list(dict.fromkeys(want)).index(x) for x in want]


def test_ruled_tables_of_small_pages_write_edges_only(spark, monkeypatch):
    rows = [(p, x * 20.0, y * 20.0, x * 20.0 + 20, y * 20.0 + 20) for p in range(3) for x in range(4) for y in range(5)]
    found = saved(monkeypatch)
    cells = rulings.ruled_tables(spark.createDataFrame(rows, "page int, x0 double, top double, x1 double, bottom double").repartition(3))
    assert cells.count() == 60
    assert {"edges", "cells"} <= set(found) and not set(found) & {"clusters", "means", "stretches"}


def test_merged_lines_are_counted_without_taking_texts_apart(spark, monkeypatch):
    plans, parted = [], ranks.parted
    monkeypatch.setattr(ranks, "parted", lambda rows, by, scratch, sizes=None: plans.append(sizes) or parted(rows, by, scratch, sizes))
    assert QUERIES["merged_lines"](spark, "/root/testdata/sf0.001").count()
    assert len(plans) == 1 and "Generate" not in plans[0]._jdf.queryExecution().optimizedPlan().toString()


def test_ends_of_lines(spark):
    """Signs before a last line separator end or open a line, too; many words are as good as six."""
    ends = ["one two three four five six seven", "a b c d e f.", "a b c d e f.\u2028", "open,", "open, \u2028", "\u00a0A B C D E", "\u00a0A B C D\u00a0", "bullet x"]
    rows = [(d, k, t, 0) for d, end in enumerate(ends) for k, t in enumerate([end, "Next line here", "and on"])]
    x = spark.createDataFrame(rows, "doc_id int, line_no int, text string, level int")
    got = pages.wrapped(x, ["doc_id"], ["line_no"], x.select("doc_id", F.lit(3).alias("n"))).where("line_no = 1").orderBy("doc_id").collect()
    assert [r.item_no for r in got] == [1, 2, 2, 1, 1, 1, 2, 2]
    assert [r.section_no for r in got] == [0, 0, 0, 0, 0, 0, 1, 0]
