"""Groups that one task may hold are gone through whole, as larger ones are over ranges."""

import random

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from folio.operators import layout, pages, ranks, rulings, tables
from folio.queries import ORACLES, QUERIES


@pytest.fixture
def both(monkeypatch):
    """Results by ranges, and those of whole groups, which need no ranges."""

    def run(make):
        monkeypatch.setattr(ranks, "LARGE", 2)
        by_ranges = sorted(map(repr, make().collect()))
        monkeypatch.setattr(ranks, "LARGE", 50_000)
        with monkeypatch.context() as m:
            m.setattr(ranks, "dealt", lambda *_: pytest.fail("small groups are dealt out by ranges"))
            whole = sorted(map(repr, make().collect()))
        assert whole == by_ranges and whole
        return whole

    return run


def test_joined_tables_of_small_runs(spark, both):
    rng = random.Random(6)
    elements = [(rng.choice([None, 1, 2]), k, rng.choice(["table", "table", "page_break", "text"]), rng.randint(0, 90), rng.randint(1, 3)) for k in range(120)]
    own = [e for e in elements if e[2] == "table"]
    columns = [(d, k, c, c * 100 + rng.randint(-40, 40), c * 100 + 70) for d, k, _, _, n in own for c in range(n) if rng.random() < 0.95]
    rows = [(d, k, r, [rng.choice(["", None, "a", "b."]) for _ in range(n)]) for d, k, _, _, n in own for r in range(rng.randint(0, 3))]
    made = [spark.createDataFrame(x, s).repartition(3) for x, s in [(elements, "doc_id int, elem_no int, type string, n_chars int, n_cols int"), (columns, "doc_id int, elem_no int, col_no int, x0 int, x1 int"), (rows, "doc_id int, elem_no int, row_no int, cells array<string>")]]
    both(lambda: tables.joined(*made))
    assert tables.joined(*(x.limit(0) for x in made)).count() == 0


def test_lines_of_small_pages(spark, both):
    rng = random.Random(10)
    rows = [(rng.choice([None, 1, 2, 3]), k, rng.randint(0, 50), top := rng.choice([rng.randint(0, 40), rng.randint(100, 900)]), top + rng.choice([0, 1, 5, 9, 60])) for k in range(400)]
    rows.append((4, 400, 0, 5, 9))
    both(lambda: layout.line_clusters(spark.createDataFrame(rows, "page int, glyph_no int, x0 int, top int, bottom int").repartition(4)))


def test_groups_over_batches(spark):
    df = spark.createDataFrame([(k % 3, k) for k in range(500)], "g int, k int").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = ranks.grouped(df, ["g"], ["k"], ["k"], lambda of: ((sum(x[0] for x in of[: i + 1]),) for i in range(len(of))), "total long").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {(r.g, r.k, r.total) for r in got} == {(k % 3, k, sum(range(k % 3, k + 1, 3))) for k in range(500)}


def test_ruled_tables_of_small_pages(spark, both):
    rng = random.Random(9)
    rows = [(p, float(x), float(y), x + 20.0 + rng.random(), y + rng.choice([0.0, 20.0])) for p in range(3) for x in range(0, 80, 20) for y in range(0, 200, 20) if rng.random() < 0.9]
    both(lambda: rulings.ruled_tables(spark.createDataFrame(rows, "page int, x0 double, top double, x1 double, bottom double").repartition(3)))


def test_joined_lines_of_small_documents(spark, both):
    rng = random.Random(12)
    rows = [(rng.choice([None, 1, 2]), k, rng.choice(["one two three four five six", "and on", "Ends.", "- item", "**bold** text", "HEAD", "open,"]), rng.choice([0, 0, 0, 1, 2])) for k in range(200)]
    both(lambda: pages.joined_lines(spark.createDataFrame(rows, "doc_id int, line_no int, text string, level int").repartition(3), ["doc_id"], ["line_no"]))


def test_places_of_small_groups(spark, both):
    rows = [(k % 4 or None, k * 7 % 50, k) for k in range(60)]
    both(lambda: ranks.running(spark.createDataFrame(rows, "g int, t int, v int").repartition(3), ["g"], ["t", "v"], F.col("v")))


def test_rows_without_a_key_are_one_group(spark, both):
    rows = [(k * 7 % 50, k) for k in range(60)]
    df = spark.createDataFrame(rows, "t int, v int").repartition(3)
    got = both(lambda: ranks.running(df, [], ["t", "v"], F.col("v")))
    ahead = [sum(v for _, v in sorted(rows)[:k]) for k in range(60)]
    assert got == sorted(f"Row(t={t}, v={v}, place={k + 1}, ahead={ahead[k]})" for k, (t, v) in enumerate(sorted(rows)))
    both(lambda: ranks.islands(df.withColumn("end", F.col("t") + F.col("v") % 3), [], "t", "end"))
    both(lambda: ranks.folded(df, [], ["t", "v"], ["v"], layout.Rising(), "repaired long"))
    assert ranks.running(df.limit(0), [], ["t"]).count() == 0


def test_records_of_repeated_keys_and_null_ids(spark, both, tmp_path):
    """As DuckDB's SQL of json_to_table has it, also where keys are numbered by ranges."""
    texts = [(None, '{"n": 1, "b": 2}'), (5, '{"m": "x|y", "c": null, "m": 3}'), (6, "{}"), (7, '{"n": 2, "d": {"e": [1, 2]}}'), (8, None)]
    spark.createDataFrame(texts, "event_id long, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    found = con.execute(ORACLES["json_to_table"])
    make = Row(*(c[0] for c in found.description))
    assert both(lambda: QUERIES["json_to_table"](spark, str(tmp_path))) == sorted(repr(make(*r)) for r in found.fetchall())
