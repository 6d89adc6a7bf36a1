"""The registered queries of the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import chat, treaps, warc
from folio.llm.digest import neighbour_digests
from folio.llm.licences import licence_scan
from folio.llm.mil import quality_scores
from folio.llm.mixing import mix_sources
from folio.llm.pieces import encode_documents
from folio.llm.quality_rules import quality_rules
from folio.llm.repair import damage_audits
from folio.llm.simhash import simhash_groups
from folio.llm.suffix import suffix_digest
from folio.llm.tokens import token_counts
from folio.llm.treaps import ranked_search
from folio.runtime import table

Query = Callable[[SparkSession, str], DataFrame]

#: The folder of the public tokenizers' vocabulary files.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
PIECES = f"{TOKENIZERS}/piece_bpe_32k.model"
BYTE_PAIRS = f"{TOKENIZERS}/byte_bpe_50k.json"
#: A folder that all jobs share, to keep token counts from run to run; without it each run begins with an empty cache.
TOKEN_CACHE = os.environ.get("TOKEN_CACHE_DIR")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_digest(table(spark, sf_dir, "documents"), words=51)


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(table(spark, sf_dir, "pages")))


def op6_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(table(spark, sf_dir, "conversations"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), PIECES, keep=["doc_id"])


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_digests(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damage_audits(table(spark, sf_dir, "conversations"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), BYTE_PAIRS, TOKEN_CACHE)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_simhash_dedup, op2_suffix_dedup, op3_licence_scan, op4_mix_sources, op5_warc_derivatives, op6_chat_perspectives, op7_sentencepiece, op8_quality_rules, op9_quality_classifier, op10_fingerprints, op11_conversation_repair, op12_ranked_search, op13_token_counts)}

ORACLES: dict[str, str] = {"op5_warc_derivatives": warc.oracle(), "op6_chat_perspectives": chat.oracle(), "op12_ranked_search": treaps.oracle()}
