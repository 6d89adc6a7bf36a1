"""The pipeline against a plain version of its stages, and the registered queries."""

import re

import duckdb
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from folio.llm.queries import ORACLES, PIECES
from folio.runtime import table

DIR = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_the_clean(spark):
    docs = table(spark, DIR, "documents")
    before, seen = {r.doc_id: r.text for r in docs.collect()}, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
        rows = docs.collect()
        seen[name] = rows
        docs = spark.createDataFrame(rows, docs.schema)
    quality, near, suffix, mix, ids = seen.values()
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    assert all(len(words(r.text)) >= 20 for r in quality)
    assert len({r.doc_id for r in near}) == len(near) <= len(quality)
    assert {r.doc_id for r in suffix} == {r.doc_id for r in near}
    assert all(r.text == before[r.doc_id] or len(r.text) < len(before[r.doc_id]) for r in suffix) and all(r.n_chars == len(r.text) for r in suffix)
    assert abs(sum(len(words(r.text)) for r in mix) - sum(len(words(r.text)) for r in suffix)) < 600  # ten documents a source don't always sum up
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert all(r.ids == sp.encode(r.text) and r.exact for r in ids) and len(ids) == len(mix)
    assert [r.doc_id for r in sorted(corpus_pipeline.run(spark, DIR).collect(), key=lambda r: r.doc_id)] == sorted(r.doc_id for r in ids)


def test_stages_take_odd_rows(spark):
    """Nulls, empty and very long texts, repeats, no rows, and columns named like the stages' own."""
    prose = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    shared = prose("same", 60)
    rows = [(i, f"{prose(i, 30)} {shared} {prose(i + 100, 30)}", "en", f"s{i % 3}", 0) for i in range(6)]
    rows += [(10, None, None, None, None), (11, "", "en", "s0", 0), (12, prose(12, 40_000), None, None, 7), (13, rows[0][1], "en", "s1", 0), (0, rows[0][1], "en", "s0", 0), (None, prose(14, 50), "xx", "s2", 3), (15, shared, "en", "s0", 1)]
    names = ["key", "mark", "one", "two", "n", "rows", "spare", "stratum", "counts", "found", "s", "e", "group", "th", "draw"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *(F.lit(7).alias(c) for c in names))
    for given in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, given, DIR)
            assert out.columns[: len(docs.columns)] == docs.columns
            rows = out.collect()
            assert all(r[c] == 7 for r in rows for c in names)
            given = spark.createDataFrame(rows, out.schema)
            if name == "simhash near-dedup" and rows:
                assert sorted((r.doc_id for r in rows), key=str) == [0, 1, 12, 15, 2, 3, 4, 5, None]
            if name == "suffix-array dedup" and rows:
                assert not any("wsamex" in r.text for r in rows) and {r.doc_id for r in rows} >= {1, 2, 12, 15}


def test_near_dedup_goes_by_fingerprints(spark):
    """A text's fingerprint is that of the shingle it has over half of the time, however little else is shared."""
    texts = ["same " * 200 + " ".join(f"w{i}x{k}" for k in range(40)) for i in range(2)] + [" ".join(f"v{k}" for k in range(60)), None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs, DIR).collect()) == [0, 2, 3]
    docs = table(spark, DIR, "documents")
    groups = entry.queries()["op1_simhash_dedup"](spark, DIR).collect()
    assert {r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs, DIR).collect()} == {r.component_id for r in groups}


def test_registered_queries(spark):
    names = list(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    con = duckdb.connect()
    for t in ("pages", "conversations", "documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    for name, sql in ORACLES.items():
        df = entry.queries()[name](spark, DIR)
        found = con.execute(sql)
        cols = [c[0] for c in found.description]
        assert sorted(df.columns) == sorted(cols)
        assert sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(map(repr, found.fetchall()))
