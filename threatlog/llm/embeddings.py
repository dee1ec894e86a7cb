"""Near-duplicate vectors by PCA-ordered tiled comparison.

Equal vectors are one class.  The classes are ordered along the first principal axis and cut into blocks;
blocks so far apart on it that no pair can reach the threshold are never paired.  In a tile of two blocks
the products of the leading principal dimensions are accumulated first; what the others can still add is
bounded by the product of the suffix norms, and the tile stops as soon as no pair can reach the threshold.
Pairs that remain are decided by the cosine of the vectors as given, in double precision.

A tile returns no pairs: for each vector the number of its links, and the links of a spanning forest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .components import components

#: Numbers in one block: it holds as many vectors as have so many components.
BLOCK = 524_288
#: Vectors of one side of a product, and principal dimensions that are accumulated at a time.
SIDE, STEP = 1024, 16
_SLACK = 1e-9


def _matrix(column):
    """A list column of one length as a matrix of doubles."""
    import numpy as np
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).reshape(len(column), -1)


def _unit(vectors):
    import numpy as np

    # Scaled first, so that squares neither overflow nor vanish.
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def _joined(labels, a, b):
    """The labels after nodes ``a`` and ``b`` are linked, pair by pair: one label per component, an old one of it."""
    import numpy as np

    now = labels.copy()
    while True:
        before, low = now.copy(), np.minimum(now[a], now[b])
        np.minimum.at(now, a, low)
        np.minimum.at(now, b, low)
        if (now == before).all():
            break
    # What one node of a label has joined, all nodes of the label have.
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    moved = now != labels
    for old, new in np.unique(np.stack([labels[moved], now[moved]], 1), axis=0).tolist():
        old, new = find(old), find(new)
        root[max(old, new)] = min(old, new)
    if not root:
        return labels
    known, at = np.unique(labels, return_inverse=True)
    return np.array([find(x) if x in root else x for x in known.tolist()], np.int64)[at]


def compare_tile(left, right, axes, threshold: float, same: bool):
    """Yield (rows of ``left``, rows of ``right``) linked, product by product; ``same``: each pair once."""
    import numpy as np

    turned = [x @ axes for x in (left, right)]
    steps = [*range(STEP, left.shape[1], STEP), left.shape[1]]
    squares = [np.cumsum((x * x)[:, ::-1], 1)[:, ::-1] for x in turned]
    suffix = [[np.sqrt(s[:, m]) if m < s.shape[1] else np.zeros(len(s)) for m in steps] for s in squares]
    for i in range(0, len(left), SIDE):
        for j in range(i if same else 0, len(right), SIDE):
            a, b = slice(i, i + SIDE), slice(j, j + SIDE)
            done, product, open_pairs = 0, 0.0, None
            for k, m in enumerate(steps):
                product = product + turned[0][a, done:m] @ turned[1][b, done:m].T
                done = m
                open_pairs = product + np.outer(suffix[0][k][a], suffix[1][k][b]) >= threshold - _SLACK
                if np.count_nonzero(open_pairs) * 50 <= open_pairs.size:
                    break
            rows, columns = np.nonzero(open_pairs)
            if len(rows) == 0:
                continue
            if 8 * len(rows) > open_pairs.size:
                exact = (left[a] @ right[b].T)[rows, columns]
            else:
                exact = np.einsum("ij,ij->i", left[a][rows], right[b][columns])
            linked = exact >= threshold
            if same and i == j:
                linked &= rows < columns
            if linked.any():
                yield rows[linked] + i, columns[linked] + j


def near_vectors(vectors: DataFrame, threshold=0.95, id_col="vec_id", vector_col="embedding") -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id``, ``kept``.

    Linked are vectors whose cosine, in double precision, is at least ``threshold``; ``n_links`` counts
    the other rows linked directly, ``component_id`` is the smallest id reachable.  A vector that is null,
    empty, zero, or holds null or non-finite components is linked with nothing, and so is one of another
    length, and a row with a null id (component null, kept).  Rows with the same id are one node, each row
    counting its own links.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    takes = F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0) & F.col("id").isNotNull()
    rows = staged(rows.withColumn("takes", F.coalesce(takes, F.lit(False))))
    used = rows.where("takes").select("id", "v")
    classes = used.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    classes = staged(classes.select("rep", F.xxhash64("v").alias("tag"), "n", F.size("v").alias("d"), "v"))

    # The second moments of each length: d * d sums, whatever the number of vectors.
    def partial(batches):
        import numpy as np
        import pyarrow as pa

        sums = {}
        for batch in batches:
            lengths = batch.column(1).to_numpy()
            for d in set(lengths.tolist()):
                unit = _unit(_matrix(batch.column(0).filter(pa.array(lengths == d))))
                sums[d] = sums.get(d, 0) + unit.T @ unit
        for d, s in sums.items():
            columns = [pa.array([d] * (d * d), pa.int32()), pa.array(np.arange(d * d)), pa.array(s.ravel())]
            yield pa.RecordBatch.from_arrays(columns, ["d", "cell", "s"])

    summed = classes.select("v", "d").mapInArrow(partial, "d int, cell bigint, s double")
    axes = _axes(summed.groupBy("d", "cell").agg(F.sum("s").alias("s")).collect())
    shared = spark.sparkContext.broadcast(axes)

    def first_axis(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lengths = batch.column(3).to_numpy()
            along = np.zeros(batch.num_rows)
            for d in set(lengths.tolist()):
                of = lengths == d
                along[of] = _unit(_matrix(batch.column(4).filter(pa.array(of)))) @ shared.value[d][:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(along)], [*batch.schema.names, "along"])

    schema = "rep bigint, tag bigint, n bigint, d int, v array<double>, along double"
    placed = staged(classes.mapInArrow(first_axis, schema))
    placed = _blocks(placed, threshold)
    left = placed.select("*", F.explode(F.sequence("block", "last")).alias("j")).withColumn("i", F.col("block"))
    right = placed.where("first < block").select("*", F.explode(F.sequence(F.col("first"), F.col("block") - 1)).alias("i"))
    right = right.withColumn("j", F.col("block"))
    tiles = left.unionByName(right).select("i", "j", "block", "rep", "tag", "n", "d", "v")

    def tile(key, table):
        import numpy as np
        import pyarrow as pa

        i, j = key[0].as_py(), key[1].as_py()
        block = table.column("block").to_numpy()
        parts = [table.filter(pa.array(block == b)) for b in ([i] if i == j else [i, j])]
        empty = {"rep": [], "tag": [], "links": [], "root": []}
        if min(p.num_rows for p in parts) == 0:
            return pa.table(empty, schema=_OUT())
        sides = [_unit(_matrix(p.column("v"))) for p in parts]
        weights = [p.column("n").to_numpy() for p in parts]
        left, right, same = sides[0], sides[-1], i == j
        counts = [np.zeros(len(w), np.int64) for w in weights]
        labels, second = np.concatenate([p.column("rep").to_numpy() for p in parts]), 0 if same else len(left)
        for rows, columns in compare_tile(left, right, shared.value[left.shape[1]], threshold, same):
            np.add.at(counts[0], rows, weights[-1][columns])
            np.add.at(counts[-1], columns, weights[0][rows])
            labels = _joined(labels, rows, columns + second)
        out = []
        for k, part in enumerate(parts):
            own = labels[: len(left)] if k == 0 else labels[len(left) :]
            hit = counts[k] > 0
            out.append((part.column("rep").to_numpy()[hit], part.column("tag").to_numpy()[hit], counts[k][hit], own[hit]))
        return pa.table([np.concatenate(c) for c in zip(*out)], schema=_OUT())

    found = staged(tiles.groupBy("i", "j").applyInArrow(tile, "rep bigint, tag bigint, links bigint, root bigint"))
    several = used.select("id", F.xxhash64("v").alias("tag")).groupBy("id").agg(F.min("tag").alias("a"), F.max("tag").alias("b"))
    keyed = used.select("id", F.xxhash64("v").alias("tag"), F.size("v").alias("d"))
    own = keyed.join(several.where("a <> b").select("id"), "id")
    own = own.join(classes.select("tag", "d", "rep"), ["tag", "d"]).select("id", "rep")
    known = components(found.select("rep", "root").union(own).toDF("a", "b"))
    counted = found.groupBy("rep", "tag").agg(F.sum("links").alias("links"))
    of_class = classes.join(counted, ["rep", "tag"], "left").join(known, classes.rep == known.node, "left")
    of_class = of_class.select(
        F.col("v"), F.col("n") + F.coalesce("links", F.lit(0)) - 1, F.coalesce("root", classes.rep)
    ).toDF("v", "links", "component")
    out = rows.where("takes").join(of_class, "v").select("id", "links", "component")
    out = out.union(rows.where("not takes").select("id", F.lit(0).cast("bigint"), "id"))
    out = out.toDF(id_col, "n_links", "component_id")
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def _OUT():
    import pyarrow as pa

    return pa.schema([(c, pa.int64()) for c in ("rep", "tag", "links", "root")])


def _axes(cells):
    """For each length the principal axes as columns, the largest variance first."""
    import numpy as np

    sums = {}
    for d, cell, s in cells:
        sums.setdefault(d, np.zeros(d * d))[cell] = s
    return {d: np.ascontiguousarray(np.linalg.eigh(s.reshape(d, d))[1][:, ::-1]) for d, s in sums.items()}


def _blocks(placed: DataFrame, threshold: float) -> DataFrame:
    """Adds ``block``, and the first and last block that ``block`` has to be compared with.

    Blocks are ranges of the first axis, by quantiles; a range that holds too many (equal places) is cut
    by a hash.  There is a row per block on the driver: one for each :data:`BLOCK` numbers of the input.
    """
    import numpy as np

    spark, reach = placed.sparkSession, float(np.sqrt(max(0.0, 2 - 2 * threshold))) + _SLACK
    cuts = []
    for d, n in sorted(placed.groupBy("d").count().collect()):
        limit = max(1, BLOCK // d)
        parts = -(-n // limit)
        if parts > 1:
            marks = placed.where(F.col("d") == d).approxQuantile("along", [k / parts for k in range(1, parts)], 0.1 / parts)
            cuts += [(d, float(x)) for x in sorted(set(marks))]
    edges = {}
    for d, x in cuts:
        edges.setdefault(d, []).append(x)
    known = spark.sparkContext.broadcast({d: np.array(x) for d, x in edges.items()})

    @F.pandas_udf("bigint")
    def range_of(d, along):
        import pandas as pd

        out = np.zeros(len(d), np.int64)
        for length in set(d):
            of = (d == length).to_numpy()
            out[of] = np.searchsorted(known.value.get(length, np.zeros(0)), along[of].to_numpy(), "right")
        return pd.Series(out)

    ranged = placed.withColumn("range", range_of("d", "along"))
    sizes = ranged.groupBy("d", "range").agg(F.count("*").alias("m"), F.min("along").alias("lo"), F.max("along").alias("hi"))
    blocks, number = [], 0
    for r in sorted(sizes.collect(), key=lambda r: (r["d"], r["range"])):
        pieces = -(-r["m"] // max(1, 2 * BLOCK // r["d"]))
        blocks.append((r["d"], r["range"], pieces, number, number + pieces - 1, r["lo"], r["hi"]))
        number += pieces
    table = []
    for d in sorted({b[0] for b in blocks}):
        own = [b for b in blocks if b[0] == d]
        lo, hi = np.array([b[5] for b in own]), np.array([b[6] for b in own])
        last = np.searchsorted(lo, hi + reach, "right") - 1
        first = np.searchsorted(hi, lo - reach, "left")
        table += [(*b[:4], own[f][3], own[x][4]) for b, f, x in zip(own, first.tolist(), last.tolist())]
    schema = "d int, range bigint, pieces bigint, start bigint, first bigint, last bigint"
    joined = ranged.join(spark.createDataFrame(table, schema), ["d", "range"])
    return joined.withColumn("block", F.col("start") + F.pmod(F.xxhash64("rep", "tag"), F.col("pieces")))
