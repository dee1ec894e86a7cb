"""Merkle manifest of a dataset: a tree per source, a tree over the sources, and for every row its proof.

A leaf is the hash of a row's fields.  The leaves of a source stand in order of their ids; every ``ARITY``
consecutive nodes have one parent, until one node, the subroot, is left.  The subroots, in order of their
sources, likewise have one root.

Nodes are numbered without a task that holds a source: a range sort of (source, id) spreads a source over many
tasks, whose counts per source, added up, are the offsets.  Leaves then belong to superblocks of ``SUPERBLOCK``
consecutive ones.  Grouped aggregations hash runs up to the superblocks' nodes; the few levels above them give each
superblock its outer nodes, that is the runs on the way to the root, passed from parents to children.  At last the
leaves and the outer nodes are cogrouped by superblock: one call finishes the superblock's inner levels, joins
inner and outer siblings to proofs and folds every (also a tampered) leaf up to the root.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

#: Children of a node, levels within a superblock, its leaves, and rows of a task of the range sort.
ARITY, LEVELS = 16, 3
SUPERBLOCK = ARITY**LEVELS
SORTED_ROWS = 1 << 17

_PATH = "array<struct<own: int, run: array<string>>>"


def hashed(*parts: Column) -> Column:
    """Lower-case hexadecimal sha256 of the parts, concatenated."""
    return F.sha2(F.concat(*[p.cast("binary") for p in parts]), 256)


def _field(value: Column) -> Column:
    """``-`` for null, else the count of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(fields: list[Column]) -> Column:
    """The leaf of a row."""
    return hashed(*[_field(f) for f in fields])


def _numbered(rows: DataFrame, tree: str | None, order: list[str]) -> DataFrame:
    """``rows`` with ``tree_no`` (place of the tree, null first), ``n`` (its rows) and ``at`` (place in it, from 0).

    Trees and rows are ordered by a range sort; its tasks' counts are the offsets.  Without ``tree`` there is one tree.
    Rows equal in all of ``order`` may trade places.
    """
    keys = ([tree] if tree else []) + order
    # Equal keys may be many: the running number lets the sort split them between tasks.
    spread = rows.withColumn("_spread", F.monotonically_increasing_id())
    tasks = max(1, -(-rows.count() // SORTED_ROWS))
    ranged = spread.repartitionByRange(tasks, *keys, "_spread").sortWithinPartitions(*keys, "_spread").drop("_spread")
    ranged = staged(ranged.withColumns({"_task": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}))
    own = F.col(tree) if tree else F.lit(0)
    shares = staged(ranged.groupBy("_task", own.alias("_tree")).agg(F.min("_row").alias("_first"), F.count("*").alias("_n")))
    if tree:
        sizes = shares.groupBy("_tree").agg(F.sum("_n").alias("_size"))
        trees = _numbered(sizes, None, ["_tree"]).select("_tree", F.col("at").alias("tree_no"), F.col("_size").alias("n"))
        shares = _null_safe(shares, trees, "_tree")
    else:
        total = shares.agg(F.sum("_n").alias("n")).select(F.lit(0).cast("bigint").alias("tree_no"), "n")
        shares = shares.crossJoin(F.broadcast(total))  # one row
    before = Window.partitionBy("tree_no").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    # A share is at most one task's rows: however large a source, no key of this join is larger.
    key = [F.col("r._task") == F.col("s._task"), F.col(f"r.{tree}").eqNullSafe(F.col("s._tree"))][: 2 if tree else 1]
    joined = ranged.alias("r").join(shares.alias("s"), key)
    place = F.col("s._before") + F.col("r._row") - F.col("s._first")
    return joined.select(*[F.col(f"r.{c}") for c in rows.columns], "s.tree_no", "s.n", place.alias("at"))


def _null_safe(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    other = right.withColumnRenamed(key, "_other")
    return left.join(other, F.col(key).eqNullSafe(F.col("_other"))).drop("_other")


def _runs(nodes: DataFrame) -> DataFrame:
    """(tree_no, n, at, node) to (tree_no, n, at, run): runs of ``ARITY`` consecutive nodes, in order."""
    pair = F.array_sort(F.collect_list(F.struct("at", "node")))
    return nodes.groupBy("tree_no", "n", F.floor(F.col("at") / ARITY).alias("at")).agg(pair["node"].alias("run"))


def _parents(runs: DataFrame) -> DataFrame:
    """The level above; ``n`` is the nodes of a tree on its level.  The only node of a tree stays as it is."""
    node = F.when(F.col("n") > 1, hashed(F.array_join("run", ""))).otherwise(F.col("run")[0])
    return runs.select("tree_no", F.ceil(F.col("n") / ARITY).alias("n"), "at", node.alias("node"))


def _outer(nodes: DataFrame) -> DataFrame:
    """(tree_no, n, at, node) to (tree_no, at, top, path): the tree's top node, and the runs from the node up to it.

    Runs go up level by level until every tree has one node; paths come down from parents to their at most
    ``ARITY`` children, so that no key of a join is larger.
    """
    levels, most = [staged(nodes)], 0
    while True:
        most = levels[-1].agg(F.max("n")).first()[0] or 0
        if most <= 1:
            break
        levels.append(staged(_parents(_runs(levels[-1]))))
    paths = levels[-1].select("tree_no", "at", F.col("node").alias("top"), F.array().cast(_PATH).alias("path"))
    for level in reversed(levels[:-1]):
        above = _runs(level).join(paths, ["tree_no", "at"])
        step = F.struct(F.col("own"), F.col("run"))
        # A tree with one node on this level has its path from above as it is.
        path = F.when(F.col("n") > 1, F.concat(F.array(step), F.col("path"))).otherwise(F.col("path"))
        below = above.select("*", F.posexplode("run").alias("own", "_node"))
        paths = below.select("tree_no", (F.col("at") * ARITY + F.col("own")).alias("at"), "top", path.alias("path"))
    return paths


def _sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode("ascii")).hexdigest()


def fold(leaf: str, path) -> str:
    """The top node that a leaf leads to; ``path`` has (own place, run) level by level."""
    for own, run in path:
        leaf = _sha(*run[:own], leaf, *run[own + 1 :])
    return leaf


def inner_runs(leaves: list[str], whole_tree: bool) -> list[list[list[str]]]:
    """The runs of a superblock's levels, up to its own node; those of a tree that is one superblock up to its top."""
    levels, nodes = [], leaves
    while len(nodes) > 1 if whole_tree else len(levels) < LEVELS:
        runs = [nodes[i : i + ARITY] for i in range(0, len(nodes), ARITY)]
        levels.append(runs)
        nodes = [_sha(*run) for run in runs]
    return levels


def manifest(
    rows: DataFrame, fields=("doc_id", "source", "lang", "n_chars", "text"), id_col="doc_id", source_col="source", tampered: dict | None = None
) -> DataFrame:
    """One row per row: id, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``.

    ``tampered`` maps fields to columns that stand for them in what is verified; null results count as a null field.
    ``proof_sha256`` is the hash of a row's siblings from leaf to root, ``folded_root`` what the tampered leaf and
    the original siblings lead to, ``verified`` whether that is the root.

    A null source is a source of its own, the first; a null id comes first in its source.  Rows of one source and id
    are ordered by their leaves; fully equal rows are leaves of their own.  The tree of a single row is its leaf, whose
    proof is the hash of nothing.  A table without rows gives none.  Other columns of ``rows`` are not read.
    """
    tampered = tampered or {}
    plain = [F.col(f) for f in fields]
    other = [tampered.get(f, F.col(f)) for f in fields]
    slim = rows.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), leaf_hash(plain).alias("leaf"), leaf_hash(other).alias("tried"),
    )
    slim = slim.withColumn("tried", F.when(F.col("tried") != F.col("leaf"), F.col("tried")))
    # Texts are read and hashed once, where they lie; all that follows is a hash or two a row.
    slim = staged(slim)
    placed = staged(_numbered(slim, "source", ["id", "leaf"]).drop("source"))
    nodes = placed.select("tree_no", "n", "at", F.col("leaf").alias("node"))
    for _ in range(LEVELS):
        nodes = _parents(_runs(nodes))
    blocks = staged(_outer(nodes))
    subroots = blocks.where("at = 0").select(F.col("tree_no").alias("at"), F.col("top").alias("node"))
    count = F.lit(subroots.count()).cast("bigint")
    tops = _outer(subroots.select(F.lit(0).cast("bigint").alias("tree_no"), count.alias("n"), "at", "node"))
    tops = tops.select(F.col("at").alias("tree_no"), F.col("top").alias("root"), F.col("path").alias("_upper"))
    outer = blocks.join(tops, "tree_no").select(
        "tree_no", F.col("at").alias("block"), F.col("top").alias("subroot"), "root", F.concat("path", "_upper").alias("path")
    )
    leaves = placed.withColumn("block", F.floor(F.col("at") / SUPERBLOCK))
    kind = rows.schema[id_col].dataType.simpleString()
    out = "subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def finish(leaves, outer):
        import pandas as pd

        leaves = leaves.sort_values("at")
        # A group without outer nodes can't be: each block of leaves has its own.
        subroot, root, above = outer["subroot"].iloc[0], outer["root"].iloc[0], [(p["own"], list(p["run"])) for p in outer["path"].iloc[0]]
        originals = leaves["leaf"].tolist()
        levels = inner_runs(originals, leaves["n"].iloc[0] <= SUPERBLOCK)
        beyond = "".join(x for own, run in above for k, x in enumerate(run) if k != own)
        proofs, folded = [], []
        for i, (leaf, tried) in enumerate(zip(originals, leaves["tried"])):
            path = []
            for runs in levels:
                i, own = divmod(i, ARITY)
                path.append((own, runs[i]))
            proofs.append(_sha(*[x for own, run in path for x in (*run[:own], *run[own + 1 :])], beyond))
            folded.append(fold(leaf if tried is None else tried, path + above))
        return pd.DataFrame(
            {
                "id": leaves["id"], "leaf": originals, "subroot": subroot, "root": root, "proof_sha256": proofs,
                "folded_root": folded, "verified": [x == root for x in folded],
            }
        )

    made = leaves.groupBy("tree_no", "block").cogroup(outer.groupBy("tree_no", "block")).applyInPandas(finish, f"id {kind}, leaf string, {out}")
    return made.withColumnRenamed("id", id_col)


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_tampering(docs: DataFrame) -> DataFrame:
    """The manifest of documents, verified with the texts lower-cased of those whose crc32 of the id 5 divides."""
    chosen = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    text = F.when(chosen, lower_ascii(F.col("text"))).otherwise(F.col("text"))
    return manifest(docs, tampered={"text": text})
