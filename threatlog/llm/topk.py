"""Exact top-k by inner product, with a KD-tree per shard.

The vectors are dealt to shards of bounded size.  A shard's tree splits at the median of its widest
dimension and keeps the tight bounding box of each node; the trees are a table.  A query goes through a
tree best first: a node's bound is the largest inner product any point of its box could have.  What it
finds in one shard it takes to the next: the kth score so far cuts off nodes there.
"""

from __future__ import annotations

import heapq
import io

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

#: Vectors of a shard and of a leaf, shards that a query goes through in one task, queries of a block.
SHARD, LEAF, GROUP, QUERIES = 4096, 64, 8, 256
_LONG = 2**63 - 1


def quantised(column, scale: int = 1024):
    """floor(scale * x) of each component, as doubles: whole numbers."""
    return F.transform(column.cast("array<double>"), lambda x: F.floor(x * scale).cast("double"))


def build_tree(points, ids):
    """Arrays of a KD-tree: points and ids in leaf order, and for each node its range, children, box and least id."""
    import numpy as np

    order, nodes, todo = np.argsort(ids, kind="stable"), [], [(0, len(ids), -1, 0)]
    children = []
    while todo:
        lo, hi, parent, side = todo.pop()
        number = len(nodes)
        own = order[lo:hi]
        low, high = points[own].min(0), points[own].max(0)
        nodes.append((lo, hi, low, high, ids[own].min()))
        children.append([-1, -1])
        if parent >= 0:
            children[parent][side] = number
        if hi - lo > LEAF:
            widest = int((high - low).argmax())
            order[lo:hi] = own[np.argsort(points[own, widest], kind="stable")]
            middle = (lo + hi) // 2
            todo += [(lo, middle, number, 0), (middle, hi, number, 1)]
    return {
        "points": points[order], "ids": ids[order], "range": np.array([n[:2] for n in nodes]), "children": np.array(children),
        "low": np.array([n[2] for n in nodes]), "high": np.array([n[3] for n in nodes]), "least": np.array([n[4] for n in nodes]),
    }


def _products(matrix, query):
    """Exact inner products of whole numbers, kept within 64 bits."""
    import numpy as np

    if np.abs(matrix).max(initial=0) * np.abs(query).sum() < 2**53:
        return (matrix @ query).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(row, query)) for row in matrix]
    return np.array([max(-_LONG, min(_LONG, x)) for x in exact], np.int64)


def search(tree, query, query_id, best: list, k: int):
    """Bring ``best`` (heap of (score, -id), the kth first) up to date with a shard."""
    import numpy as np

    terms = np.maximum(query * tree["low"], query * tree["high"])
    # A bound may not be rounded below a score: terms cancel, so the slack is that of their sizes, one unit in the last
    # place for each product and each sum.  Scores are held within 64 bits, so bounds are not below the least of them.
    bounds = terms.sum(1) + np.abs(terms).sum(1) * (2 * len(query) * 2.0**-52)
    bounds = np.maximum(bounds, -(2.0**63) + 2.0**11)
    children, least = tree["children"], tree["least"]
    queue = [(-bounds[0], int(least[0]), 0)]
    while queue:
        bound, lowest, node = heapq.heappop(queue)
        if len(best) == k:
            score, negative = best[0]
            if -bound < score:
                return
            if -bound == score and lowest > -negative:
                continue
        left, right = children[node]
        if left >= 0:
            for child in (left, right):
                heapq.heappush(queue, (-bounds[child], int(least[child]), int(child)))
            continue
        lo, hi = tree["range"][node]
        ids, scores = tree["ids"][lo:hi], _products(tree["points"][lo:hi], query)
        if len(best) == k:
            near = np.flatnonzero(scores >= best[0][0])
            ids, scores = ids[near], scores[near]
        for number, score in zip(ids.tolist(), scores.tolist()):
            if number == query_id:
                continue
            if len(best) < k:
                heapq.heappush(best, (score, -number))
            elif (score, -number) > best[0]:
                heapq.heapreplace(best, (score, -number))


def top_k(vectors: DataFrame, is_query, k=10, scale=1024, id_col="vec_id", vector_col="embedding") -> DataFrame:
    """The k best candidates of each query: ``query_id``, ``rank`` (from 1), id, ``score`` (bigint).

    Components become floor(scale * x); the score is the inner product (both held within 64 bits), and equal
    scores go to the smaller id.  ``is_query`` is a condition on the rows of ``vectors``; candidates are all rows but those
    with the query's id.  Null ids and vectors that are null, empty or hold null or non-finite components
    take no part; vectors of another length are no candidates.  Rows equal in id and vector count once; an id
    with several vectors asks once for each.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    rows = rows.where("id is not null and v is not null").where((F.size("v") > 0) & finite)
    rows = rows.select("id", "asks", quantised(F.col("v"), scale).alias("v"), F.size("v").alias("d"))
    rows = staged(rows.dropDuplicates(["id", "v"]))
    sizes = rows.groupBy("d").agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("int")).alias("q"))
    sizes = sizes.select(
        "d", F.ceil(F.col("n") / SHARD).alias("shards"), F.greatest(F.lit(1), F.ceil(F.col("q") / QUERIES)).alias("blocks")
    )
    rows = rows.join(staged(sizes), "d")
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), "shards"))

    def build(key, table):
        import numpy as np
        import pyarrow as pa

        points = np.stack([x.values.to_numpy() for x in table.column("v")])
        held = io.BytesIO()
        np.savez(held, **build_tree(points, table.column("id").to_numpy()))
        first = {c: table.column(c).slice(0, 1) for c in ("d", "shard", "blocks")}
        return pa.table(first | {"tree": pa.array([held.getvalue()], pa.binary())})

    trees = dealt.groupBy("d", "shard").applyInArrow(build, "d int, shard bigint, blocks bigint, tree binary")
    trees = staged(trees).withColumn("part", F.floor(F.col("shard") / GROUP))
    trees = trees.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
    asked = rows.where("asks").withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), "blocks"))
    last = F.floor((F.col("shards") - 1) / GROUP)
    asked = asked.withColumn("tag", F.xxhash64("v")).select("d", "id", "tag", "v", "block", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("part"))

    def go_through(key, queries, shards):
        import numpy as np
        import pyarrow as pa

        out = {"query_id": [], "tag": [], "id": [], "score": []}
        loaded = []
        if queries.num_rows:
            for held in shards.sort_by("shard").column("tree"):
                with np.load(io.BytesIO(held.as_py())) as arrays:
                    loaded.append(dict(arrays))
        for query_id, tag, vector in zip(*[queries.column(c).to_pylist() for c in ("id", "tag")], queries.column("v")):
            query, best = vector.values.to_numpy(), []
            for tree in loaded:
                search(tree, query, query_id, best, k)
            for score, negative in best:
                out["query_id"].append(query_id)
                out["tag"].append(tag)
                out["id"].append(-negative)
                out["score"].append(score)
        return pa.table(out, schema=pa.schema([(c, pa.int64()) for c in out]))

    found = asked.groupBy("d", "part", "block").cogroup(trees.groupBy("d", "part", "block")).applyInArrow(
        go_through, "query_id bigint, tag bigint, id bigint, score bigint"
    )
    order = Window.partitionBy("query_id", "tag").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
