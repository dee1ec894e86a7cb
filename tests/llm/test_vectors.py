import numpy as np
import pytest
from pyspark.sql import functions as F

from threatlog.llm import embeddings, topk
from threatlog.llm.embeddings import near_vectors
from threatlog.llm.topk import top_k

VECTORS = "vec_id bigint, embedding array<float>, label int, id string, v string, n int, score double, rank int"


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y", 1, 0.5, 9) for i, v in rows], VECTORS)


def _valid(v, zero):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))


def _random(seed, n, d=8, spread=0.15):
    make = np.random.default_rng(seed)
    centres = make.normal(size=(max(2, n // 5), d))
    out = []
    for i in range(n):
        v = centres[make.integers(len(centres))] + spread * make.normal(size=d)
        out.append((i, [float(np.float32(x)) for x in v]))
    return out


ODD = [
    (900, None), (901, []), (902, [0.0] * 8), (903, [None] + [1.0] * 7), (904, [float("nan")] * 8), (905, [float("inf")] + [0.0] * 7),
    (906, [1.0] * 8), (907, [1.0] * 8), (907, [1.0] * 8), (908, [2.0] * 8), (909, [1.0, 2.0]), (910, [1.0, 2.0]), (None, [1.0] * 8),
    (911, [1e30] * 8), (912, [1e-30] * 8), (913, [-1.0] * 8), (914, [3.0] * 7 + [3.1]), (914, [-1.0] * 7 + [-1.1]),
]


def near_brute(rows, threshold):
    use = [(i, np.array(v, float)) for i, v in rows if i is not None and _valid(v, False)]
    links = [0] * len(use)
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(use):
        for b, (j, y) in enumerate(use[:a]):
            if len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                links[a] += 1
                links[b] += 1
                low, high = sorted((find(i), find(j)))
                root[high] = low
    of = {}
    for (i, v), n in zip(use, links):
        of.setdefault(i, []).append(n)
    for i, v in rows:
        if i is None or not _valid(v, False):
            of.setdefault(i, []).append(0)
    return sorted([(i, n, find(i) if i is not None else None) for i, ns in of.items() for n in ns], key=repr)


@pytest.mark.parametrize("block", [64, 524_288])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    for rows in (_random(1, 150), _random(2, 80) + ODD):
        found = near_vectors(_frame(spark, rows)).collect()
        assert sorted([tuple(r)[:3] for r in found], key=repr) == near_brute(rows, 0.95)
        assert all(r["kept"] == (r["vec_id"] is None or r["vec_id"] == r["component_id"]) for r in found)


def test_near_vectors_of_nothing(spark):
    assert near_vectors(_frame(spark, [])).count() == 0
    assert [tuple(r) for r in near_vectors(_frame(spark, [(1, None)])).collect()] == [(1, 0, 1, True)]


def test_tiles_stop_early_and_lose_nothing():
    make = np.random.default_rng(5)
    left, right = (embeddings._unit(make.normal(size=(n, 40)) * np.linspace(2, 0.1, 40)) for n in (300, 200))
    right[:50] = embeddings._unit(left[:50] + 0.02 * make.normal(size=(50, 40)))
    axes = np.linalg.eigh(left.T @ left)[1][:, ::-1]
    found = {(i, j) for a, b in embeddings.compare_tile(left, right, axes, 0.95, False) for i, j in zip(a.tolist(), b.tolist())}
    assert found == set(zip(*[x.tolist() for x in np.nonzero(left @ right.T >= 0.95)]))


def held(x):
    return max(-(2**63 - 1), min(2**63 - 1, x))


def top_brute(rows, k):
    seen, use = set(), []
    for i, v in rows:
        if i is not None and _valid(v, True):
            # Components and scores are held within 64 bits, as the docstring says.
            q = tuple(held(int(np.floor(1024 * float(x)))) for x in v)
            if (i, q) not in seen:
                seen.add((i, q))
                use.append((i, q))
    out = []
    for i, q in use:
        if i % 10 == 0:
            scored = sorted((-held(sum(a * b for a, b in zip(q, p))), j) for j, p in use if j != i and len(p) == len(q))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 40)
    monkeypatch.setattr(topk, "LEAF", 4)
    monkeypatch.setattr(topk, "GROUP", 2)
    monkeypatch.setattr(topk, "QUERIES", 3)
    same = [(1000 + i, [0.25] * 8) for i in range(60)]
    for rows in (_random(3, 120), _random(4, 60) + same + ODD, [(0, [1.0]), (1, [2.0])]):
        found = top_k(_frame(spark, rows), F.col("vec_id") % 10 == 0).collect()
        assert sorted(map(tuple, found)) == top_brute(rows, 10)
    assert top_k(_frame(spark, []), F.col("vec_id") % 10 == 0).count() == 0


def test_products_beyond_doubles_are_exact():
    matrix = np.array([[2.0**40, 3.0], [2.0**20, 1.0]])
    assert topk._products(matrix, np.array([2.0**20, 1.0])).tolist() == [2**60 + 3, 2**40 + 1]


@pytest.mark.parametrize("size", [2**10, 2**27, 2**40, 2**62])
def test_search_loses_nothing_to_rounding(size, monkeypatch):
    """Large whole numbers whose products cancel: bounds must hold to the last digit."""
    monkeypatch.setattr(topk, "LEAF", 4)
    make = np.random.default_rng(size % 1009)
    for trial in range(60):
        d = int(make.integers(2, 9))
        points = np.floor(size + make.integers(-40, 40, (200, d)).astype(float) * max(1, size // 2**24))
        points *= make.choice([-1.0, 1.0], d)
        points[make.integers(0, 200, 20)] = points[0]
        ids = np.arange(1000, 1200)
        query = np.floor(size + make.integers(-40, 40, d).astype(float)) * np.where(np.arange(d) % 2, -1.0, 1.0)
        best = []
        topk.search(topk.build_tree(points, ids), query, 7, best, 10)
        exact = [max(-(2**63 - 1), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(p, query)))) for p in points]
        assert sorted(best, reverse=True) == sorted(((x, -i) for x, i in zip(exact, ids.tolist())), reverse=True)[:10]
