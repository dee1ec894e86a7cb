"""A corpus pipeline over ``documents``: language, toxicity, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept; :func:`run` writes
each result as Parquet to the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threatlog.llm.language import UNKNOWN, learn_profiles, predict_languages
from threatlog.llm.neardup import near_duplicates
from threatlog.llm.packing import pack
from threatlog.llm.pii import redacted
from threatlog.llm.texts import free_name, with_mark
from threatlog.llm.toxicity import without_toxic
from threatlog.session import staged

#: A text whose profile is so unlike that of every language is rejected; real ones score 0.38 and more.
LEAST_SCORE = 0.2


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null and empty ones too) and such in none of the learned languages.

    Without any labelled document there is nothing to judge by: all stay.  Equal rows and ids are judged one by one.
    """
    profiles = staged(learn_profiles(docs))
    if profiles.isEmpty():
        return docs
    found = predict_languages(docs, profiles, keep=docs.columns)
    lang, score = found.columns[-2:]
    return found.where((F.col(lang) != UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier chain, learned from ``labels``, calls toxic.

    Null and empty texts hold no features and stay; rows with equal ids are judged each by its own text.
    """
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (five words, 0.8): that with the smallest id.

    Rows with a null id stay.  Rows with an id that stays do so once for each different text: two texts under one id
    are two documents, and equal rows are copies.
    """
    flags = staged(near_duplicates(docs, words=5, percent=80).select("doc_id", "kept"))
    gone = staged(flags.where("not kept").select("doc_id").distinct())
    # Documents that surely stay are not shuffled.
    mark = free_name("may_go", docs.columns)
    marked = with_mark(docs, "doc_id", gone, mark)
    left = marked.where(~F.col(mark)).union(marked.where(F.col(mark)).join(gone, "doc_id", "left_anti").select(*docs.columns, mark))
    left = left.select(*docs.columns)
    several = staged(flags.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if several.isEmpty():
        return left
    first = Window.partitionBy("doc_id", "text").orderBy(F.xxhash64(*docs.columns))
    ranked = left.join(several, "doc_id", "left_semi").select("*", F.row_number().over(first).alias("_row_of_id"))
    return left.join(several, "doc_id", "left_anti").select(*docs.columns).union(ranked.where("_row_of_id = 1").select(*docs.columns))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in texts by its kind; ``n_chars`` follows the text where that has changed."""
    return redacted(docs, length_col="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens; a null or empty text is the end token alone."""
    return pack(docs)


STAGES = [
    ("language", known_language),
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_each_group),
    ("personal_data", redact),
    ("packing", packed),
]

#: SQL can express neither the models nor the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
