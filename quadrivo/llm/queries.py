"""One query for each training-data operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ball_kmeans import CLUSTERS_SQL, ball_kmeans
from .chat_format import DIGESTS_SQL, chat_digests
from .co_training import quality_classifier
from .fill_middle import DIGESTS_SQL as MIDDLES_SQL
from .fill_middle import fill_middle_digests
from .forced_bpe import bpe_round_trip
from .language_id import language_id
from .media import media_digests
from .packing import pack
from .prefix_bpe import bpe_digests
from .quality_rules import quality_rules
from .shared import table
from .simhash import near_duplicates
from .sorted_table import sorted_table
from .token_counts import token_counts

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"), WORD_BPE)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), BYTE_BPE).drop("ids")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op5_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.element_at(F.array(F.lit("user"), F.lit("assistant")), F.col("id").cast("int") + 1).alias("role"), F.lit(said).alias("text"))
    return chat_digests(rows.unionByName(more))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))


def op8_sorted_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorted_table(table(spark, sf_dir, "documents"), BYTE_BPE)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), BYTE_BPE)


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle_digests(table(spark, sf_dir, "documents"))


def op12_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_bpe": op2_bpe,
    "op3_packing": op3_packing,
    "op4_language_id": op4_language_id,
    "op5_co_training": op5_co_training,
    "op6_chat_format": op6_chat_format,
    "op7_media": op7_media,
    "op8_sorted_table": op8_sorted_table,
    "op9_simhash": op9_simhash,
    "op10_token_counts": op10_token_counts,
    "op11_fill_middle": op11_fill_middle,
    "op12_prefix_bpe": op12_prefix_bpe,
    "op13_ball_kmeans": op13_ball_kmeans,
}
ORACLE_SQL: dict[str, str] = {"op6_chat_format": DIGESTS_SQL, "op11_fill_middle": MIDDLES_SQL, "op13_ball_kmeans": CLUSTERS_SQL}
