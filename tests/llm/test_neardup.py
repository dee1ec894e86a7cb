import random

import pytest

from threatlog.llm import neardup
from threatlog.llm.components import components
from threatlog.llm.neardup import least_overlap, near_duplicates
from threatlog.llm.queries import op3_minhash


def shingles(text, words):
    found = (text or "").encode().lower().split()
    if not found:
        return frozenset()
    n = min(len(found), words)
    return frozenset(tuple(found[i : i + n]) for i in range(len(found) - n + 1))


def brute_force(pairs, words, percent):
    sets = {}
    for i, t in pairs:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t, words))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            for x in sets[a]:
                for y in sets[b]:
                    if x and 100 * len(x & y) >= percent * len(x | y):
                        low, high = sorted((find(a), find(b)))
                        root[high] = low
    return {i: find(i) for i in ids}


def _check(docs, pairs, words, percent):
    rows = near_duplicates(docs(pairs), words, percent).collect()
    expected = brute_force(pairs, words, percent)
    assert len(rows) == len(pairs)
    for r in rows:
        assert r["component_id"] == expected.get(r["doc_id"])
        assert r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"])
    assert sorted((r["doc_id"] or 0, r["n_shingles"]) for r in rows) == sorted((i or 0, len(shingles(t, words))) for i, t in pairs)


def _corpus(seed, groups, size, length, passage=0):
    make = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    common = " ".join(make.choice(words) for _ in range(passage))
    pairs, number = [], 0
    for _ in range(groups):
        base = [make.choice(words) for _ in range(make.randint(3, length))]
        for _ in range(make.randint(1, size)):
            text = list(base)
            for _ in range(make.randint(0, 3)):
                text[make.randrange(len(text))] = make.choice(words)
            pairs.append((number, " ".join(text) + (" " + common if make.random() < 0.5 else "")))
            number += 1
    make.shuffle(pairs)
    return pairs


@pytest.mark.parametrize("words, percent", [(3, 85), (5, 80)])
def test_same_as_brute_force(docs, words, percent):
    _check(docs, _corpus(words, 40, 6, 120), words, percent)


def test_common_passage_and_large_groups_in_tiles(docs, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 8)
    _check(docs, _corpus(11, 4, 60, 60, passage=40), 3, 85)
    _check(docs, _corpus(12, 60, 2, 12, passage=30), 3, 85)


def test_odd_documents(odd, none, docs):
    pairs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    _check(docs, pairs, 3, 85)
    assert near_duplicates(none).count() == 0
    rows = near_duplicates(docs([(1, None), (2, ""), (None, None)])).collect()
    assert all(r["kept"] and r["n_shingles"] == 0 for r in rows)


def test_an_id_with_several_texts_is_one_document(docs):
    a, b = "a b c d e f g h i j", "k l m n o p q r s t"
    _check(docs, [(5, a), (5, b), (3, a), (2, b), (9, a)], 3, 85)


def test_least_overlap_is_safe():
    for k, similarity in ((48, 0.85), (48, 0.8), (16, 0.9)):
        c = least_overlap(k, similarity)
        make, low = random.Random(1), k
        for _ in range(3000):
            low = min(low, sum(make.random() < similarity for _ in range(k)))
        assert 0 < c <= low


def test_components(spark):
    make = random.Random(8)
    links = [(make.randrange(300), make.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_registered(spark):
    sf = "/root/testdata/sf0.001"
    pairs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    expected = brute_force(pairs, 3, 85)
    assert {r["doc_id"]: r["component_id"] for r in op3_minhash(spark, sf).collect()} == expected
