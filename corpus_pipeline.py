"""Training-corpus pipeline: language, near copies, repeated passages, personal data, packing.

Every stage works on all rows its predecessor kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartograf.llm.common import counted, materialise
from cartograf.llm.langid import UNKNOWN, held_out, identify, train
from cartograf.llm.neardup import near_duplicates
from cartograf.llm.packing import pack
from cartograf.llm.pii import find_personal_data
from cartograf.llm.suffixes import remove_repeats

MIN_SCORE = 0.3  # a text that the classifier can't tell from chance goes
SHINGLE, PERCENT = 5, 80
PASSAGE = 100  # bytes; more than 50 words have more


def with_text(df: DataFrame, text, like: DataFrame) -> DataFrame:
    """The columns of ``like`` with another text, and its number of characters where there is such a column."""
    df = df.withColumn("text", text)
    if "n_chars" in like.columns:
        df = df.withColumn("n_chars", F.length("text").cast(dict(like.dtypes)["n_chars"]))
    return df.select(*like.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: null, empty, without letters, or not told from chance.

    Rows that repeat stay as they are; columns may be named like the classifier's. An empty table gives an empty one.
    """
    model = train(docs.filter(~held_out()))
    told = identify(docs.select(*[F.col(c).alias(f"in_{c}") for c in docs.columns]), model, text="in_text")
    kept = told.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_SCORE))
    return kept.select(*[F.col(f"in_{c}").alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays, rows that repeat id and text once.

    Rows without an id, and texts that are null or without words, belong to no group and stay. Rows with one id and several texts
    are one document and stay or go together.
    """
    found = near_duplicates(docs, size=SHINGLE, percent=PERCENT)
    by_id = found.filter("doc_id is not null").groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
    gone = materialise(by_id.filter(~F.col("kept")).select("doc_id"), "near-gone")
    again = by_id.filter(F.col("kept") & (F.col("rows") > 1)).select("doc_id")
    if again.isEmpty():
        return docs.join(counted(gone), "doc_id", "left_anti").select(*docs.columns)
    once = docs.join(gone.unionByName(again), "doc_id", "left_anti")
    return once.unionByName(docs.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in a document with a smaller id are cut out; a document that nothing is left of goes.

    What is left of a character that is cut in two is dropped. Rows without an id keep their text and take none away; rows
    that repeat an id count as one document; null texts, and those of white space only, go.
    """
    found = remove_repeats(docs.select("*", F.col("doc_id").alias("__id")), key="__id", width=PASSAGE, kept=True)
    return with_text(found, F.col("kept_text"), docs).filter(F.coalesce(F.col("text").rlike(r"\S"), F.lit(False)))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets. All rows stay; null texts stay null."""
    found = find_personal_data(docs)
    return with_text(found, F.col("clean_text"), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens, sources in proportion.

    Null and empty texts are one token, the end id; null sources are a queue of their own; rows that repeat are packed each.
    """
    return pack(docs, ids=False)


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: SQL can't express the classifier, the groups or the tokens; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
