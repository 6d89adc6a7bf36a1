"""Reading order, wrapped lines, cards, bands and folds of hot groups against plain loops."""

import random
import re

import pytest
from plain_pages import joined, lines_of, page_text
from pyspark.sql import functions as F

from folio.operators import layout, pages, ranks

GLYPH = "page long, glyph_no long, x0 double, x1 double, top double, bottom double, text string, size double, bold boolean, italic boolean"
NAMES = [x.split()[0] for x in GLYPH.split(", ")]


def spread(spark):
    """Ranges stay apart, so groups lie in several of them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")


@pytest.fixture
def apart(spark):
    spread(spark)
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def some_page(rng, kind):
    """Glyphs of a page of words, its columns by kind."""
    out = []
    words = ["Alpha", "beta,", "gamma", "DELTA", "•", "of", "Epsilon.", "12", "zeta", "ETA", "theta;", "- iota", "Ab", "x", "long-word/", "**"]
    starts = {0: [40.0], 1: [40.0, 330.0], 2: [40.0, 230.0, 420.0], 3: [40.0, 330.0], 4: [40.0, 430.0]}[kind]
    y = 10.0
    for r in range(rng.randrange(2, 14)):
        size = rng.choice([24.0, 14.0, 10.0, 10.0, 10.0])
        for k, x in enumerate(starts if r and rng.random() < 0.8 else starts[:1]):
            for _ in range(rng.randrange(1, 5) if kind != 3 or r % 3 else 1):
                w = rng.choice(words if kind != 4 or not k else ["a", "bc", "d"]) if kind != 3 or r % 3 else rng.choice(["HEAD", "TOP"])
                wide = 5.0 * len(w)
                out.append([x, x + wide, y + rng.choice([0, 0.5, 1]), y + size + rng.choice([0, 0.5]), w, size, rng.random() < 0.15, rng.random() < 0.1])
                x += wide + rng.choice([0.5, 4.0])
        y += size + rng.choice([-4.0, 2.0, 30.0])
    return out


def test_pages_like_loops(spark):
    rng, rows = random.Random(5), []
    for page in range(60):
        rows += [(page, no, *g) for no, g in enumerate(some_page(rng, page % 5))]
    rows += [(0, 9999, -5.0, 1.0, 3.0, 9.0, "off", 9.0, False, False), (None, 1, 1.0, 2.0, 1.0, 2.0, "x", 9.0, False, False), (900, 1, 5.0, 9.0, 1.0, 9.0, None, 9.0, None, None), (901, 1, 5.0, 9.0, 1.0, 9.0, "•", 9.0, None, None), (902, 1, 5.0, 9.0, 1.0, 9.0, "Solo", 9.0, None, None)]
    cells = [("Ask", "TELL"), ("who it is", "the story"), ("and why.", "of a day."), ("MORE", "LESS"), ("one", "two")]
    rows += [(903, k * 2 + side, 40.0 + 300 * side, 90.0 + 300 * side, 100.0 + 30 * k, 124.0 + 30 * k, t, 24.0 if k == 0 else 10.0, False, False) for k, both in enumerate(cells) for side, t in enumerate(both)]
    rows += [(903, 99, 40.0, 90.0, 5.0, 29.0, "Title", 24.0, False, False), (903, 98, 40.0, 50.0, 40.0, 50.0, "7", 10.0, False, False)]
    df = spark.createDataFrame([(*r, "x") for r in rows], GLYPH + ", level string").repartition(5)
    got = {r["page"]: (r["layout"], r["text"]) for r in pages.page_texts(df).collect()}
    by = {}
    for r in rows:
        if r[0] is not None and r[6] is not None:
            by.setdefault(r[0], []).append(dict(zip(NAMES, r, strict=True)))
    want = {p: page_text(g) for p, g in by.items()}
    assert {p: t for p, t in got.items() if t[1] != want[p][1]} == {p: w for p, w in want.items() if got.get(p, w)[1] != w[1]} == {}
    want.pop(901)  # without any text
    assert {p: t[0] for p, t in got.items() if p != 901} == {p: w[0] for p, w in want.items()}
    assert got[903] == ("comparison", "**7**\n\n# Title\n\n| Ask | TELL |\n| --- | --- |\n| who it is<br><br>and why. | the story<br><br>of a day. |\n| **MORE** | **LESS** |\n| one | two |")
    assert {w[0] for w in want.values()} == {"text", "columns", "grid", "drawing", "comparison"}
    assert pages.page_texts(df.limit(0)).count() == 0


def test_a_page_of_many_glyphs_is_spread(spark, apart):
    rng = random.Random(6)
    rows = [(1, k, rng.random() * 500, 0.0, top := rng.random() * 3000, top + rng.choice([1.0, 1.5, 2.0, 9.0])) for k in range(1500)]
    df = spark.createDataFrame(rows, "page long, glyph_no long, x0 double, x1 double, top double, bottom double").repartition(4)
    got = {}
    for r in layout.line_clusters(df).collect():
        got.setdefault(r["line_no"], set()).add(r["glyph_no"])
    want = [{g["glyph_no"] for g in line} for line in lines_of([dict(zip(["page", "glyph_no", "x0", "x1", "top", "bottom"], r, strict=True)) for r in rows])]
    assert [got[k + 1] for k in range(len(want))] == want and len(got) == len(want)
    bands = ranks.islands(df, ["page"], "top", "bottom", name="band").groupBy("band").count().collect()
    assert len(bands) > 100 and max(r["count"] for r in bands) < 300


def test_wrapped_lines_of_a_hot_document(spark, apart):
    rng = random.Random(7)
    pool = ["and so on", "Then it goes, with", "It ends.", "- an item", "**Bold** start", "Five words stand in here", "Short one", "TITLE", "x", "Open –", "   "]
    rows = [(1, k, rng.choice(pool), rng.choice([0, 0, 0, 1, 2])) for k in range(3000)] + [(2, k, "low", 0) for k in range(40)] + [(None, 0, "A", 0), (None, 1, "b", 0)]
    df = spark.createDataFrame(rows, "doc_id long, seq long, text string, level int").repartition(6)
    got = {}
    for r in pages.joined_lines(df, ["doc_id"], ["seq"]).orderBy("item_no").collect():
        got.setdefault(r["doc_id"], []).append((r["text"], r["level"]))
    for doc in (1, 2, None):
        assert got[doc] == joined([(t, v) for d, _, t, v in rows if d == doc])
    heads = pages.wrapped(df, ["doc_id"], ["seq"]).where("doc_id = 1").orderBy("seq").select("text", "level", "section_no").collect()
    n = 0
    for r in heads:
        n += r["level"] > 0 or r["text"].isupper() and len(r["text"].split()) <= 4
        assert r["section_no"] == n


def test_numbers_of_a_hot_article(spark, apart):
    rng, want = random.Random(8), []
    rows = [(1, 1, k, rng.choice([None, None, rng.randrange(-2, 9), k // 3, k])) for k in range(2500)] + [(1, 2, k, [None, 0, 0, 5, None, 1][k]) for k in range(6)]
    for article in (1, 2):
        last = 0
        for _, a, k, n in rows:
            if a == article:
                last = last + 1 if n is None or last >= 2 and n <= last else n
                want.append((article, k, last))
    df = spark.createDataFrame(rows, "doc_id int, article int, seq int, number int").repartition(5)
    assert sorted((r["article"], r["seq"], r["repaired"]) for r in layout.clause_numbers(df).collect()) == want


def test_islands_of_a_hot_group(spark, apart):
    rng = random.Random(9)
    rows = [(1, s := rng.random() * 4000, s + rng.random() * 4) for _ in range(2000)] + [(2, 0.0, 1.0), (2, 1.0, 2.0), (2, 2.5, 3.0), (None, 1.0, 1.0)]
    got = sorted(map(tuple, ranks.islands(spark.createDataFrame(rows, "island2 int, a double, b double"), ["island2"], "a", "b").collect()), key=repr)
    want, far = [], {}
    for g, a, b in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *r[1:])):
        end, n = far.get(g, (None, 0))
        n += end is None or a > end
        far[g] = (b if end is None else max(end, b), n)
        want.append((g, a, b, n))
    assert got == sorted(want, key=repr)


def test_names_of_a_callers_columns_stay(spark):
    x = spark.createDataFrame([(1, k, 7, 8, 9) for k in range(5)], "g int, part int, pos int, _range int, `a.b` int")
    got = ranks.running(x, ["g"], ["part"], F.col("part")).orderBy("part").collect()
    assert got[0].asDict() == {"g": 1, "part": 0, "pos": 7, "_range": 8, "a.b": 9, "place": 1, "ahead": 0} and [r["ahead"] for r in got] == [0, 0, 1, 3, 6]


CARDS = [
    (["1\nPlan\nWrite it\ndown", "2\nDo\nMake it", "Check\nLook"], "cards", None, ["Plan", "Do", "Check"], ["Write it<br>down", "Make it", "Look"]),
    (["Left\na", "Root\nMid\nb", "Right\nc"], "cards", "Root", ["Left", "Mid", "Right"], ["a", "b", "c"]),
    (["KH\nLearn\nmore", "Teach\nagain"], "cards", None, ["Learn", "Teach"], ["more", "again"]),
    (["lower\ntext", "Upper\ntext"], "rejected", None, None, None),
    (["Với\ntext", "Upper\ntext"], "rejected", None, None, None),
    (["One two three four five six\ntext", "Upper\ntext"], "rejected", None, None, None),
    (["plain", "cells"], "kept", None, None, None),
    (["only\none"], "kept", None, None, None),
    ([None, " "], "kept", None, None, None),
]


def test_card_tables(spark):
    rows = [(k, 1, 5, c) for k, (c, *_) in enumerate(CARDS)] + [(k, 1, 1, [" ", None]) for k in range(len(CARDS))] + [(99, 1, k, ["A\nb", "C\nd"]) for k in range(2)] + [(98, 1, 0, None)]
    df = spark.createDataFrame(rows, "doc_id int, table_no int, row_no int, cells array<string>")
    got = {r["doc_id"]: (r["verdict"], r["title"], r["header"], r["body"]) for r in pages.card_tables(df).collect()}
    assert {k: got[k] for k in range(len(CARDS))} == {k: tuple(want) for k, (_, *want) in enumerate(CARDS)}
    assert got[99][0] == got[98][0] == "kept"


def test_levels_beyond_the_deepest(spark):
    x = spark.createDataFrame([(1, k, v, True) for k, v in enumerate([1, 10, 0, None, 1])], "doc_id int, seq int, level int, numbered boolean")
    assert [r["number"] for r in layout.item_numbers(x).orderBy("seq").collect()] == [1, None, None, None, 1]  # a level of 0 is a higher one


def test_patterns_agree():
    for t in ("so.", "so –", "a,", "end”", "x"):
        assert bool(re.search(pages.ENDS, t)) == bool(re.search(r"([.!?…;~”\"’»\)\]\}]|\.\.\.)$", t))
