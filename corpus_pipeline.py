"""From raw documents to token ids: filter, dedup, mix and encode.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before
has kept. The written table of a stage is the next one's input.

Null and empty texts have no words, so the first stage rejects them. Later on an
empty text is a document like any other until the mix, which never takes one.
Rows that repeat an id and a text are one in the second stage; rows without an id
can't be told from each other, and stay. A null language is a stratum, a null
source a source. An empty table stays one. Columns beside those of documents go
through all stages as they are, whatever their names, but for the three that the
last one makes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folio.llm.mixing import mixed_documents
from folio.llm.pieces import encode_documents
from folio.llm.quality_rules import keep_good
from folio.llm.queries import PIECES
from folio.llm.simhash import near_dedup
from folio.llm.suffix import remove_repeats
from folio.runtime import Scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose SimHash fingerprints link them, at 2 or fewer
    differing bits, the one with the smallest id stays: op1_simhash_dedup's operator."""
    return near_dedup(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes and passages of over 50 words that are found twice are
    cut out of the texts. A text that is nothing else stays as an empty one."""
    return remove_repeats(docs, words=51, length_col="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are dropped or repeated until the sources have their shares."""
    return mixed_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts' token ids come as columns more. The stages before leave an executor
    little memory, so less is remembered of the texts than the operator would."""
    return encode_documents(docs, PIECES, memory_mb=48)


STAGES = [("quality rules", quality_rules), ("simhash near-dedup", simhash_dedup), ("suffix-array dedup", suffix_dedup), ("source mixing", mix_sources), ("sentencepiece encoding", sentencepiece)]

#: The stages are beyond SQL; tests/llm/test_pipeline.py holds run() against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, beginning with the documents table."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}")
    return docs
