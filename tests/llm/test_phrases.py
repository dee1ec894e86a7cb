import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threatlog.llm import phrases
from threatlog.llm.phrases import _counted, collocations, combined, frequent_ngrams, numbered_words, packed, shrunk, survivors, unpacked
from threatlog.session import staged

SCHEMA = "doc_id bigint, text string, lang string, size int, phrase string, f bigint, hashes string"


def _lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def _counts(rows):
    """Counter of (lang, words) and of words per lang, by walking the texts."""
    found, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", _lower(text)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(words)
            for n in (1, 2, 3, 4):
                for i in range(len(words) - n + 1):
                    found[lang, tuple(words[i : i + n])] += 1
    return found, total


def _expected(rows, threshold, best):
    found, total = _counts(rows)
    frequent = {k: a for k, a in found.items() if a >= threshold and len(k[1]) > 1}
    out = {}
    for (lang, words), a in frequent.items():
        cuts = [((2_000_000 * a) // (found[lang, words[:k]] + found[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        if any(
            g == lang and len(v) > len(words) and 100 * b >= 80 * a and any(v[i : i + len(words)] == words for i in range(len(v)))
            for (g, v), b in frequent.items()
        ):
            continue
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), found[lang, words[:k]], found[lang, words[k:]]))
    rows = []
    for lang, entries in out.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(entries)[:best], 1):
            rows.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(rows)


def _table(spark, rows):
    return spark.createDataFrame([(i, t, g, 1, "p", 2, "h") for i, (t, g) in enumerate(rows)], SCHEMA)


def _rows(n, seed, words="a b c d e Ff É 日本 x1 'q".split()):
    make = random.Random(seed)
    joins = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", ":"]
    for _ in range(n):
        yield "".join(make.choice(words) + make.choice(joins) for _ in range(make.randint(0, 60))), make.choice(["en", "fr", None, "und"])


@pytest.mark.parametrize("threshold, best", [(5, 2000), (12, 7)])
def test_same_as_walking_the_texts(spark, threshold, best):
    rows = list(_rows(120, threshold))
    found = sorted(tuple(r) for r in collocations(_table(spark, rows), threshold, best).collect())
    assert found == _expected(rows, threshold, best)
    assert found


def test_many_ranges_of_hashes(spark, monkeypatch):
    monkeypatch.setattr(phrases, "MASS", 500)
    rows = list(_rows(100, 9))
    found = {(r["lang"], tuple(r["phrase"].split(" "))): r["f"] for r in frequent_ngrams(_table(spark, rows), 4).where("size > 0").collect()}
    assert found == {k: a for k, a in _counts(rows)[0].items() if a >= 4}


def test_rows_of_summaries_are_short(spark):
    rows = [(" ".join(f"w{i}x{k}" for k in range(20_000)), "en") for i in range(6)]
    docs = _table(spark, rows).selectExpr("lang", "text").coalesce(1)
    summaries = phrases._summaries(docs).selectExpr("length(summary) as n", "mass").collect()
    assert max(r["n"] for r in summaries) < 1 << 16
    assert sum(r["mass"] for r in summaries) == 6 * (20_000 + 19_999)


def test_a_task_writes_its_summaries_in_blocks(spark, tmp_path):
    make = random.Random(1)
    rows = spark.createDataFrame([(bytearray(make.randbytes(20_000)), 1) for _ in range(600)], "summary binary, mass bigint").coalesce(1)
    assert staged(rows, path=str(tmp_path / "s"), block_bytes=2 << 20).count() == 600
    (file,) = (tmp_path / "s").glob("*.parquet")
    found = pq.ParquetFile(file).metadata
    assert max(found.row_group(i).total_byte_size for i in range(found.num_row_groups)) < 5 << 20


def test_short_rows_are_cut_into_ranges(spark, monkeypatch):
    monkeypatch.setattr(phrases, "ROW", 7)
    rows = list(_rows(100, 9))
    for mass in (300, 1 << 21):
        monkeypatch.setattr(phrases, "MASS", mass)
        found = {(r["lang"], tuple(r["phrase"].split(" "))): r["f"] for r in frequent_ngrams(_table(spark, rows), 4).where("size > 0").collect()}
        assert found == {k: a for k, a in _counts(rows)[0].items() if a >= 4}


@pytest.mark.parametrize("set_to", ["4096", "100"])
def test_settings_are_as_before_and_marks_are_given_back(spark, monkeypatch, set_to):
    key, made = "spark.sql.parquet.columnarReaderBatchSize", []
    before, broadcast = spark.conf.get(key), type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: made.append(broadcast(self, value)) or made[-1])
    spark.conf.set(key, set_to)
    try:
        found = frequent_ngrams(_table(spark, list(_rows(20, 3))), 3)
        assert spark.conf.get(key) == set_to
    finally:
        spark.conf.set(key, before)
    assert found.count() and len(made) == 2
    assert not any(m._jbroadcast.isValid() for m in made if m._jbroadcast is not None)


def test_a_full_table_of_marks_changes_nothing(spark):
    rows = list(_rows(60, 4))
    full = spark.sparkContext.broadcast(b"\xff" * (1 << (phrases.MARK_BITS - 3)))
    docs = _table(spark, rows).selectExpr("coalesce(lang, 'und') as lang", "text")
    some = sorted(map(tuple, frequent_ngrams(_table(spark, rows), 3).collect()))
    assert sorted(map(tuple, _counted(docs, 3, full, full).collect())) == some


def test_odd_rows(spark):
    rows = [(None, "en"), ("", "en"), (" \n\t", None), ("word " * 50_000 + "x" * 100_000, "en"), ("New York " * 40, None), ("new york. " * 40, "und")] + [("same text here now ok", "de")] * 31
    found = sorted(tuple(r) for r in collocations(_table(spark, rows)).collect())
    assert found == _expected(rows, 30, 2000)
    assert {r[0] for r in found} == {"en", "und", "de"}
    assert collocations(_table(spark, [])).count() == collocations(_table(spark, [("few words", "en")])).count() == 0


def test_numbers_beyond_64_bits(spark):
    counts = spark.createDataFrame([("en", 1, "a", 2**61), ("en", 1, "b", 2**61 - 1), ("en", 2, "a b", 2**61 - 3)], "lang string, size int, phrase string, f bigint")
    row = phrases._scored(counts).first()
    assert row["score"] == 2_000_000 * (2**61 - 3) // (2**62 - 1)


@given(st.lists(st.lists(st.integers(0, 60), max_size=80), max_size=12), st.integers(1, 12))
@settings(max_examples=200, deadline=None)
def test_every_frequent_hash_survives_any_merging(tasks, threshold):
    parts = [np.unique(np.array(t, np.uint64), return_counts=True) for t in tasks]
    total = Counter(x for t in tasks for x in t)
    kept = set(survivors([(h, c.astype(np.int64)) for h, c in parts], threshold).tolist())
    assert {x for x, n in total.items() if n >= threshold} <= kept <= set(total)


def test_shrinking_bounds_counters_and_loss():
    hashes, counts = np.arange(10, dtype=np.uint64), np.array([9, 1, 1, 5, 1, 2, 2, 1, 7, 1], np.int64)
    kept, left, lowered = shrunk(hashes, counts, 3)
    assert (kept.tolist(), left.tolist(), lowered) == ([0, 3, 8], [7, 3, 5], 2)
    assert combined(np.array([3, 1, 3], np.uint64), np.array([1, 2, 4]))[1].tolist() == [2, 5]


def test_words():
    numbers, ids = numbered_words([b"A b\tA. c", "É b\x0bb".encode()])
    assert [list(numbers)[i] for i in ids] == [b"a", b"b", b"a", b"\xff", b"c", b"\xff", "É".encode(), b"b", b"\xff", b"b"]


@given(st.dictionaries(st.integers(0, 2**48 - 1), st.integers(1, 2**40), min_size=1, max_size=50), st.sampled_from([1, 2**10, 2**40]))
def test_packed_summaries(entries, most):
    hashes = np.array(sorted(entries), np.uint64)
    counts = np.array([min(entries[int(h)], most) for h in hashes], np.int64)
    back = unpacked(packed(hashes, counts))
    assert back[0].tolist() == hashes.tolist() and back[1].tolist() == counts.tolist()
