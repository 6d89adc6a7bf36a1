"""Files are packed from plain rows, a few documents at a time."""

from pyspark.sql import functions as F

from folio.plans import convert
from folio.sources import files


def test_packing_goes_by_arrow(spark):
    rows = spark.range(0, 200, 1, 1).select(F.col("id").cast("string").alias("doc_id"), F.array(F.struct(F.lit(0).alias("line_no"), F.array(F.col("id").cast("string")).alias("cells"))).alias("rows"))
    got = {r.path: bytes(r.content).decode() for r in convert._packed(rows, lambda of: f"{type(of).__name__} {of[0]['cells'][0]}".encode()).collect()}
    assert got == {str(k): f"list {k}" for k in range(200)}


def test_packed_documents_are_whole(spark):
    docs = spark.range(0, 120, 1, 1).select(F.concat(F.col("id").cast("string"), F.lit(".docx")).alias("path"), F.concat(F.lit("# Title "), F.col("id").cast("string"), F.lit("\n\ntext\n\n| a | b |\n| --- | --- |\n| 1 | 2 |")).alias("text"))
    got = {r.path: r.text for r in files.imported(convert.exported(docs, ".docx")).collect()}
    assert len(got) == 120 and all(f"Title {k}" in got[f"{k}.docx"] and "| 1 | 2 |" in got[f"{k}.docx"] for k in range(120))
