from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from test_neardup import brute_force, shingles
from test_pii import brute

SF = "/root/testdata/sf0.001"


def _rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_stages_hold_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.staged(stage(spark, docs, SF))
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns
    assert [x for x, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "personal_data", "packing"]

    before, after = seen["language"]
    assert _rows(before, "doc_id") == _rows(after, "doc_id")  # all documents of this table have a language

    before, after = seen["toxicity"]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in after.collect()}
    clean = [r["doc_id"] for r in before.collect() if labels.get(r["doc_id"]) == 0]
    assert sum(x not in kept for x in clean) <= 0.02 * len(clean)  # learned from some eighty labels only

    before, after = seen["near_duplicates"]
    component = brute_force([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80)
    assert {r["doc_id"] for r in after.collect()} == set(component.values())

    before, after = seen["personal_data"]
    texts = {r["doc_id"]: r for r in after.collect()}
    for r in before.collect():
        spans, now = brute(r["text"]), texts[r["doc_id"]]
        assert (now["text"] == r["text"]) == (not spans)
        assert Counter(x for x in brute(now["text"])) == Counter() and now["n_chars"] == (len(now["text"]) if spans else r["n_chars"])

    before, after = seen["packing"]
    lengths = after.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("of")).collect()
    assert {r["doc_id"] for r in lengths} == {r["doc_id"] for r in before.collect()} and all(r["n"] == r["of"] for r in lengths)
    assert corpus_pipeline.run(spark, SF).count() == after.count()


def test_odd_documents_pass_through(spark, odd, none, tmp_path):
    spark.createDataFrame([(5, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for table in (odd, none):
        table.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path)).collect()
        kept = {r["doc_id"] for r in out}
        # What has letters stays, once for each different text; 6 and 7 are copies of 5.
        assert kept == (set() if table is none else {None, 4, 5, 8, 9})
        assert len({(r["doc_id"], r["doc_tokens"], r["ids_crc32"]) for r in out if r["doc_id"] == 8}) == (0 if table is none else 2)


def test_unlabelled_documents_stay(spark, docs):
    rows = docs([(1, "some words"), (2, None), (3, "123")], lang=None)
    assert sorted(r["doc_id"] for r in corpus_pipeline.known_language(spark, rows, "").collect()) == [1, 2, 3]


def test_one_of_a_group_and_every_text_of_an_id_stay(spark, docs):
    text = " ".join(f"w{i}" for i in range(30))
    rows = docs([(1, text), (1, text), (2, text), (3, text + " x"), (None, text), (4, "other words here"), (4, "and a second text"), (4, "other words here")])
    found = corpus_pipeline.one_of_each_group(spark, rows, "")
    assert found.columns == rows.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in found.collect()) == [(0, text), (1, text), (4, "and a second text"), (4, "other words here")]
    assert shingles(text, 5)
