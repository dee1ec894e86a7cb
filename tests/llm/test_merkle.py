import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from threatlog.llm import merkle
from threatlog.llm.merkle import ARITY, fold, inner_runs, manifest, with_tampering

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, at int, n int, leaf string, id string, tree_no string"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]])


def _lower(text):
    return text and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def _tree(nodes):
    """Top node, and for each node the siblings and (own, run) steps, by walking the whole tree."""
    steps, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + ARITY] for i in range(0, len(nodes), ARITY)]
        for k, at in enumerate(own):
            steps[k].append((at % ARITY, runs[at // ARITY]))
            own[k] = at // ARITY
        nodes = [_h(*run) for run in runs]
    return nodes[0], steps


def _expected(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    order = lambda r: (r[0] is not None, r[0] or 0, _leaf(r))
    trees = {s: sorted([r for r in rows if r[1] == s], key=order) for s in sources}
    subs = {s: _tree([_leaf(r) for r in trees[s]]) for s in sources}
    root, upper = _tree([subs[s][0] for s in sources])
    out = []
    for s, above in zip(sources, upper):
        subroot, steps = subs[s]
        for row, path in zip(trees[s], steps):
            path = path + above
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            folded = _leaf((*row[:4], _lower(row[4]))) if tampered else _leaf(row)
            for own, run in path:
                folded = _h(*run[:own], folded, *run[own + 1 :])
            proof = _h(*[x for own, run in path for k, x in enumerate(run) if k != own])
            out.append((row[0], _leaf(row), subroot, root, proof, folded, folded == root))
    return sorted(out, key=repr)


def _found(spark, rows):
    return sorted((tuple(r) for r in with_tampering(spark.createDataFrame([(*r, 1, 2, "l", "i", "t") for r in rows], SCHEMA)).collect()), key=repr)


def _rows(sizes, make):
    letters = "abcXYZé日 "
    ids = random.Random(1).sample(range(10**6), sum(sizes.values()))
    for source, n in sizes.items():
        for _ in range(n):
            text = "".join(make.choice(letters) for _ in range(make.randint(0, 12)))
            yield ids.pop(), source, make.choice(["en", None]), make.choice([len(text), None]), make.choice([text, text, None])


def test_same_as_walking_the_trees(spark):
    rows = list(_rows({"a": 1, "B": 2, None: 17, "é": 300, "": 16, "zz": 5}, random.Random(2)))
    assert _found(spark, rows) == _expected(rows)


def test_several_superblocks_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SORTED_ROWS", 700)
    rows = list(_rows({"hot": 4096 + 4096 + 3, "cold": 30, "one": 1, "full": 4096}, random.Random(3)))
    assert _found(spark, rows) == _expected(rows)


def test_many_sources(spark):
    rows = list(_rows({f"s{i}": 1 + i % 3 for i in range(300)}, random.Random(4)))
    assert _found(spark, rows) == _expected(rows)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None)] * 3 + [(5, "s", "en", 1, "A")] * 40 + [(5, "s", "en", 1, "B"), (7, "s", None, None, "LONG " * 50_000), (-1, "s", "", 0, "")]
    found = _found(spark, rows)
    assert len(found) == len(rows)
    assert found == _expected(rows)


@pytest.mark.parametrize("rows", [[], [(3, "s", "en", 2, "Ab")]])
def test_none_and_one(spark, rows):
    assert _found(spark, rows) == (_expected(rows) if rows else [])


def test_any_change_is_seen(spark):
    rows = list(_rows({"a": 40, "b": 20}, random.Random(5)))
    docs = spark.createDataFrame([(*r, 1, 2, "l", "i", "t") for r in rows], SCHEMA)
    for field in ("lang", "n_chars", "text"):
        change = {field: F.when(F.col("doc_id") == rows[7][0], F.lit("9")).otherwise(F.col(field).cast("string"))}
        failed = [r["doc_id"] for r in manifest(docs, tampered=change).where("not verified").collect()]
        assert failed == ([] if rows[7][("doc_id", "source", "lang", "n_chars", "text").index(field)] == "9" else [rows[7][0]])


def test_fold_and_inner_runs():
    leaves = [_h(str(i)) for i in range(33)]
    levels = inner_runs(leaves, True)
    assert [len(runs) for runs in levels] == [3, 1]
    top, steps = _tree(leaves)
    assert all(fold(x, s) == top for x, s in zip(leaves, steps))
    assert [len(runs) for runs in inner_runs(leaves, False)] == [3, 1, 1]
