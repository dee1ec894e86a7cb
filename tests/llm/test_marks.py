"""Marks: no key that is there goes unmarked, and few others are marked."""

from pyspark.sql import functions as F

from threatlog.llm.texts import with_mark


def test_marks(spark):
    rows = spark.range(-2000, 2000).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("x"))
    rows = rows.union(spark.createDataFrame([(None, "null"), (7, "again")], "doc_id bigint, text string"))
    keys = rows.where("doc_id % 10 = 0 or doc_id is null").select("doc_id")
    found = with_mark(rows, "doc_id", keys, "may")
    assert found.columns == ["doc_id", "text", "may"]
    got = [(r["doc_id"], r["may"]) for r in found.collect()]
    assert len(got) == 4002
    assert all(may for k, may in got if k is None or k % 10 == 0)
    assert sum(may for k, may in got if k is not None and k % 10) < 20


def test_no_keys(spark):
    rows = spark.range(5).withColumn("_word", F.lit(1)).withColumn("_bits", F.lit("x"))
    assert with_mark(rows, "id", rows.where("id < 0"), "may").where("may").count() == 0
    assert with_mark(rows.where("id < 0"), "id", rows, "may").count() == 0
