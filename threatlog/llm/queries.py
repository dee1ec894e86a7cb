"""One registered query per operator, over its whole table, with the parameters it is meant to run with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_folder
from .bpe import bpe_digests
from .embeddings import near_vectors
from .language import learn_profiles, predict_languages
from .merkle import with_tampering
from .neardup import near_duplicates
from .packing import pack
from .phrases import collocations
from .pii import span_digests
from .rank_bpe import encoding_digests
from .sql import ORACLES
from .token_counts import count_tokens
from .topk import top_k
from .toxicity import toxicity
from .warc import archived_pages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    # Where the held-out condition is null (a null id), the row is not learned from.
    profiles = learn_profiles(docs.where(~out))
    found = predict_languages(docs, profiles)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=85)


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(_table(spark, sf_dir, "pages"), scratch_folder(spark))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op11_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(_table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_tampering(_table(spark, sf_dir, "documents"))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = (
        op1_language, op2_toxicity, op3_minhash, op4_topk, op5_bpe, op6_warc, op7_pii, op8_token_counts, op9_packing,
        op10_near_vectors, op11_rank_bpe, op12_collocations, op13_manifest,
    )
    return {f.__name__: f for f in found} | {"pipeline": _pipeline}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
