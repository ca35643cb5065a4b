"""Registered queries of this package, each over its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sentrel.functions.staging import staging_dir
from sentrel.llm import (
    bpe,
    chat,
    embeddings,
    html,
    licenses,
    minhash,
    mixing,
    negatives,
    quality,
    runs,
    token_counts,
    toxicity,
    urls,
)
from sentrel.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_chat_formatting")
def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_chats(rows.unionByName(chat.control_case(spark)), "byte_bpe_50k.json"))


@query("op2_source_mixing")
def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


@query("op3_minhash_near_duplicates")
def minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.report(table(spark, sf_dir, "documents"))


@query("op4_token_counts")
def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = f"{staging_dir(spark)}/sentrel-token-counts-{uuid.uuid4().hex}"
    return token_counts.measure(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", cache)


@query("op5_toxicity")
def toxic_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_quality_rules", quality.sql())
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents")).drop("quality")


@query("op7_url_filter", urls.sql())
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


@query("op8_embedding_near_duplicates")
def embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.report(table(spark, sf_dir, "embeddings"))


@query("op9_main_text")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


@query("op10_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), "byte_bpe_multi_50k.tiktoken")


@query("op11_periodic_runs")
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.report(table(spark, sf_dir, "documents"))


@query("op12_license_scan", licenses.sql())
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


@query("op13_hard_negatives", negatives.sql())
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.report(table(spark, sf_dir, "embeddings"))
