"""Queries over the training-data operators, one for each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import SQL as CHAT_SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import count_tokens

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, limit=1024).drop("text")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import encode_bytes

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_bytes(docs, ids=False).drop("text")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import remove_repeats

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, width=50, kept=False).drop("text")


def op3_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .flac import read_back, store

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_back(store(docs).drop("text")).drop("media")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), ids=False)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import rotate_perspectives

    return rotate_perspectives(table(spark, sf_dir, "conversations"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import held_out, identify, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    model = train(docs.filter(~F.col("held_out")))
    return identify(docs.select("doc_id", "text", "held_out"), model).drop("text")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_personal_data

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_personal_data(docs, clean=False).drop("text")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    return search(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_flac_media": op3_flac_media,
    "op4_packing": op4_packing,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_language_id": op8_language_id,
    "op9_personal_data": op9_personal_data,
    "op10_nearest_neighbours": op10_nearest_neighbours,
    "pipeline": pipeline,
}

ORACLE: dict[str, str] = {"op7_chat_formatting": CHAT_SQL}
