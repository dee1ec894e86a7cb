"""Near-duplicate documents by bottom-k sketches of word shingles.

One hash function gives each shingle a value; a document's sketch is its k smallest values.

1. Documents with the same shingle set become one class, so exact copies cost nothing further.
2. Inverted lists of retained values generate the overlaps.  If two classes are similar enough, they
   share at least c of their retained values but for a chance below :data:`MISSED`; so the rarest
   common value is among the first (size - c + 1) of either, in order of rarity, and only these
   prefixes are listed.  What many documents share is therefore listed only where it is most of a
   document.
3. The bottom-k sketch of the union, made from the two sketches, estimates the Jaccard similarity and
   filters the pairs, with the same c.
4. The full sets of the remaining pairs verify them exactly.

A list is not expanded to its pairs.  First each member is compared with three members of its lists that
all lists rank alike (hubs): the most central one, whose values others retain most, which is the original
where copies have been changed each in its own way, and two more; what that links is one component.  Then
only members of lists with several components are compared, in tiles, the smaller components against the
others, each pair in the list of its rarest common value alone.  So a large group of copies costs its
size, and nothing is capped.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .bytelevel import BoundedCache
from .components import components
from .texts import bounded_batches, slices, with_mark

SKETCH = 48
#: Chance at most that a pair at the threshold shares fewer than c of its retained values.
MISSED = 1e-8
#: Members of a tile's side, and values of the wider sketches that a tile compares: with smaller sets it decides.
TILE, WIDE = 1024, 1024
#: Words whose hash a worker keeps.
CACHED = 200_000


def least_overlap(k: int, similarity: float, missed: float = MISSED) -> int:
    """The largest c for which fewer than c of k values being common has a chance below ``missed``."""
    chance, c = 0.0, 0
    for x in range(k + 1):
        chance += math.comb(k, x) * similarity**x * (1 - similarity) ** (k - x)
        if chance >= missed:
            break
        c = x + 1
    return c


def _mixed(h):
    """A bijective scramble of 64-bit values."""
    import numpy as np

    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_values(text, words: int, value_of):
    """The sorted distinct 64-bit values of a text's shingles; fewer words than ``words`` are one shingle."""
    import numpy as np

    found = text.encode("utf-8").lower().split() if text else []
    n = len(found)
    if not n:
        return np.zeros(0, np.uint64)
    long = min(n, words)
    values = np.fromiter(map(value_of, found), np.uint64, n)
    h = np.full(n - long + 1, long, np.uint64)
    for j in range(long):
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + values[j : n - long + 1 + j])
    return np.unique(h)


def _value_of():
    import xxhash

    return BoundedCache(xxhash.xxh64_intdigest, CACHED).__getitem__


def _texts(docs, id_col, text_col):
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))


def sketches(docs: DataFrame, words: int, k: int, id_col="doc_id", text_col="text") -> DataFrame:
    """``id``, ``n_shingles``, ``set_key`` (128 bits of the whole set), ``sketch`` (array of the k smallest values)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        value_of = _value_of()
        for batch in slices(batches):
            sizes, keys, kept = [], [], []
            for text in batch.column(1):
                values = shingle_values(text.as_py(), words, value_of)
                sizes.append(len(values))
                keys.append(xxhash.xxh3_128_digest(values.tobytes()))
                kept.append(values[:k].view(np.int64))
            ends = np.cumsum([0] + [len(x) for x in kept])
            flat = pa.array(np.concatenate(kept) if kept else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_shingles", "set_key", "sketch"])

    return _texts(docs, id_col, text_col).mapInArrow(
        run, "id bigint, n_shingles bigint, set_key binary, sketch array<bigint>"
    )


def full_sets(docs: DataFrame, ids: DataFrame, words: int, id_col="doc_id", text_col="text", most=None) -> DataFrame:
    """``set_key`` and ``values`` (the whole set, or its ``most`` smallest values, as bytes) of the documents in
    ``ids`` (``id``, ``set_key``)."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        value_of = _value_of()
        for batch in slices(batches):
            sets = [shingle_values(text.as_py(), words, value_of).tobytes() for text in batch.column(0)]
            keys = [xxhash.xxh3_128_digest(x) for x in sets]
            # A repeated id may have another text too.
            wanted = [a == b for a, b in zip(keys, batch.column(1).to_pylist())]
            sets = [x[: 8 * most] for x in sets] if most else sets
            columns = [pa.array(x, pa.binary()).filter(pa.array(wanted, pa.bool_())) for x in (keys, sets)]
            yield pa.RecordBatch.from_arrays(columns, ["set_key", "values"])

    texts = with_mark(_texts(docs, id_col, text_col), "id", ids, "wanted").where("wanted")
    texts = texts.join(ids, "id").select("text", "set_key")
    return texts.mapInArrow(run, "set_key binary, values binary").dropDuplicates(["set_key"])


def _prefixes(classes: DataFrame, k: int, similarity: float) -> DataFrame:
    """``rep``, ``prefix``, ``weight``: the rarest retained values (n, value) of each class, in order of rarity, of
    those that another class retains too; and how often all of its values are retained."""
    c = least_overlap(k, similarity)
    size = F.size("sketch")
    # With a whole set in the sketch, and that of any partner, the overlap is certain; else it is c at least.
    whole = F.floor(F.col("n_shingles") / similarity + 1e-9) <= k
    needed = F.when(whole, F.ceil(size * similarity - 1e-9)).otherwise(F.least(F.lit(c), F.ceil(size * similarity - 1e-9)))
    first = classes.select("rep", (size - F.greatest(needed, F.lit(1)) + 1).alias("first"), size.alias("size"), "sketch")
    values = first.select("rep", F.explode("sketch").alias("value"))
    shared = values.groupBy("value").agg(F.count("*").alias("n")).where("n > 1")
    rows = values.join(shared, "value").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "value"))).alias("known"))
    rows = rows.join(first.select("rep", "first", "size"), "rep")
    # Values that no other class retains come first in order of rarity.
    take = F.col("first") - (F.col("size") - F.size("known"))
    weight = F.aggregate("known", F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"])
    return rows.where(take > 0).select("rep", F.slice("known", F.lit(1), take).alias("prefix"), weight.alias("weight"))


def _listed(prefixes: DataFrame) -> DataFrame:
    """The inverted lists: ``value``, ``n`` (classes that retain it), ``rep``, ``weight``."""
    rows = prefixes.select("rep", "weight", F.explode("prefix").alias("of"))
    return rows.select("of.value", "of.n", "rep", "weight")


def _close(a, b, sizes, k: int, c: int, similarity: float) -> bool:
    """Whether the union's sketch leaves the pair possible."""
    import numpy as np

    common = np.intersect1d(a, b, assume_unique=True)
    if len(common) == 0 or min(sizes) < similarity * max(sizes) - 1e-9:
        return False
    union = np.union1d(a, b)
    if max(sizes) <= k and len(union) <= k:
        return len(common) >= similarity * len(union) - 1e-9
    sketch = union[:k]
    return int(np.isin(sketch, common, assume_unique=True).sum()) >= min(c, math.ceil(similarity * len(sketch) - 1e-9))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (``a``, ``b``, ``key_a``, ``key_b``) whose full sets have the similarity."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in slices(batches):
            good = []
            for left, right in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(left.as_py(), np.uint64), np.frombuffer(right.as_py(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            good = pa.array(good, pa.bool_())
            columns = [batch.column(i).filter(good) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b"])

    left = sets.select(F.col("set_key").alias("key_a"), F.col("values").alias("left"))
    right = sets.select(F.col("set_key").alias("key_b"), F.col("values").alias("right"))
    rows = pairs.join(left, "key_a").join(right, "key_b").select("a", "b", "left", "right")
    return rows.mapInArrow(run, "a bigint, b bigint")


def _hub_pairs(prefixes: DataFrame) -> DataFrame:
    """Each class with the hubs of its lists: the first member by weight, by id and by a hash of it."""
    by = [F.struct((-F.col("weight")).alias("o"), "rep"), F.struct(F.col("rep").alias("o"), "rep")]
    by += [F.struct(F.xxhash64("rep", F.lit(1)).alias("o"), "rep")]
    lists = _listed(prefixes)
    hubs = lists.groupBy("value").agg(F.count("*").alias("n"), *[F.min(x).alias(f"h{i}") for i, x in enumerate(by)])
    hubs = hubs.where("n > 1").select("value", F.array_distinct(F.array("h0.rep", "h1.rep", "h2.rep")).alias("hubs"))
    pairs = lists.join(hubs, "value").select("rep", F.explode("hubs").alias("hub")).where("rep <> hub")
    return pairs.select(F.greatest("rep", "hub").alias("a"), F.least("rep", "hub").alias("b")).distinct()


def _filtered(pairs: DataFrame, classes: DataFrame, k: int, similarity: float) -> DataFrame:
    """Pairs (``a``, ``b``) that the union's sketch leaves possible, with the keys of their sets."""
    c = least_overlap(k, similarity)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            sizes = list(zip(column["n_a"].to_pylist(), column["n_b"].to_pylist()))
            sketch = [[x.values.to_numpy().view(np.uint64) for x in column[s]] for s in ("s_a", "s_b")]
            good = pa.array([_close(x, y, n, k, c, similarity) for x, y, n in zip(*sketch, sizes)], pa.bool_())
            names = ["a", "b", "key_a", "key_b"]
            yield pa.RecordBatch.from_arrays([column[x].filter(good) for x in names], names)

    def side(x):
        return classes.select(*[F.col(c).alias(d) for c, d in (("rep", x), ("set_key", f"key_{x}"), ("n_shingles", f"n_{x}"), ("sketch", f"s_{x}"))])

    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    return rows.mapInArrow(run, "a bigint, b bigint, key_a binary, key_b binary")


def _tiled_pairs(prefixes, roots, classes, wider, k: int, percent: int) -> DataFrame:
    """Possible pairs of classes of different components that share a listed value; ``wider(ids)`` gives wider sketches.

    Lists with the same members count once.  In a list, the members of all components but the largest are
    cut into blocks and meet each other and the blocks of the largest, a tile at a time.
    """
    similarity, wide = percent / 100, WIDE
    c, c_wide = least_overlap(k, similarity), least_overlap(wide, similarity)
    rows = prefixes.join(roots, prefixes.rep == roots.node, "left")
    rows = rows.select("rep", F.coalesce("root", "rep").alias("root"), F.explode("prefix").alias("of"))
    rows = staged(rows.select("of.value", F.col("of.n").alias("retained"), "rep", "root"))
    same = rows.groupBy("value", "retained").agg(
        F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"),
        F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"),
    )
    open_lists = same.where("n > 2 and low <> high").groupBy("n", "x", "y")
    # Of lists with the same members the rarest value stays: it is the rarest one that they have in common.
    open_lists = open_lists.agg(F.min(F.struct("retained", "value")).alias("first")).select("first.value")
    rows = rows.join(open_lists, "value").drop("retained")
    sizes = rows.groupBy("value", "root").agg(F.count("*").alias("n"))
    lists = sizes.groupBy("value").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("most"))
    lists = lists.select(
        "value", F.col("most.root").alias("major"), F.ceil((F.col("n") - F.col("most.n")) / TILE).alias("minors"),
        F.ceil(F.col("most.n") / TILE).alias("majors"),
    )
    rows = rows.join(lists, "value").withColumn("is_major", F.col("root") == F.col("major"))
    block = F.pmod(F.xxhash64("rep", F.lit("block")), F.when(F.col("is_major"), F.col("majors")).otherwise(F.col("minors")))
    rows = rows.withColumn("block", block + F.when(F.col("is_major"), F.col("minors")).otherwise(0))
    last = F.when(F.col("is_major"), F.col("minors")).otherwise(F.col("minors") + F.col("majors")) - 1
    tiles = rows.select("value", "rep", "root", "block", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("other"))
    tiles = tiles.select("value", "rep", "root", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    order = prefixes.select("rep", F.transform("prefix", lambda x: x["value"]).alias("prefix"))
    members = classes.join(rows.select("rep").distinct(), "rep", "left_semi")
    ids = staged(members.select(F.col("rep").alias("id"), "set_key"))
    members = members.join(order, "rep").join(wider(ids), "set_key")
    tiles = tiles.join(members.select("rep", "set_key", "n_shingles", "sketch", "prefix", "values"), "rep")
    dealt = tiles.repartition("value", "i", "j").sortWithinPartitions("value", "i", "j")

    def pairs_of(rows):
        import numpy as np

        i, j = rows[0]["i"], rows[0]["j"]
        left = [r for r in rows if r["block"] == i]
        right = left if i == j else [r for r in rows if r["block"] == j]
        if not left or not right:
            return
        across = np.array([r["root"] for r in right])
        sizes = np.array([r["n_shingles"] for r in right], float)
        flat = np.concatenate([r["sketch"] for r in right])
        owner = np.repeat(np.arange(len(right)), [len(r["sketch"]) for r in right])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        for at, r in enumerate(left):
            lo, hi = np.searchsorted(flat, r["sketch"], "left"), np.searchsorted(flat, r["sketch"], "right")
            common = np.zeros(len(right), np.int64)
            for x, y in zip(lo, hi):
                common[owner[x:y]] += 1
            least = min(c, math.ceil(similarity * min(len(r["sketch"]), k) - 1e-9))
            n = r["n_shingles"]
            fits = (np.minimum(sizes, n) >= similarity * np.maximum(sizes, n) - 1e-9) & (across != r["root"]) & (common >= least)
            if i == j:
                fits[: at + 1] = False
            linked = set()
            for other in np.flatnonzero(fits):
                s = right[other]
                # In each of the two the values are in order of rarity.
                if s["root"] in linked or next(filter(s["among"].__contains__, r["prefix"])) != r["value"]:
                    continue
                both = n, s["n_shingles"]
                if max(both) <= wide:
                    # Whole sets: one link with a component is enough.
                    common = len(np.intersect1d(r["wide"], s["wide"], assume_unique=True))
                    if 100 * common < percent * (sum(both) - common):
                        continue
                    linked.add(s["root"])
                elif not _close(r["wide"], s["wide"], both, wide, c_wide, similarity):
                    continue
                yield r["rep"], s["rep"], r["set_key"], s["set_key"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        tile, held = None, []

        def out(found):
            found = list(found)
            columns = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, ["a", "b", "key_a", "key_b"])

        for batch in batches:
            sketch = [x.values.to_numpy() for x in batch.column(batch.schema.get_field_index("sketch"))]
            for row, s in zip(batch.drop_columns(["sketch"]).to_pylist(), sketch):
                row["wide"] = np.frombuffer(row.pop("values"), np.uint64)
                key = row["value"], row["i"], row["j"]
                if key != tile:
                    if held:
                        yield out(pairs_of(held))
                    tile, held = key, []
                held.append(row | {"sketch": np.array(s), "among": frozenset(row["prefix"])})
        if held:
            yield out(pairs_of(held))

    found = dealt.mapInArrow(run, "a bigint, b bigint, key_a binary, key_b binary")
    return found.dropDuplicates(["a", "b"])


def near_duplicates(docs: DataFrame, words=5, percent=80, k=SKETCH, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id``, ``kept``.

    Documents are linked if ``100 * intersection >= percent * union`` of their sets of ``words``-word
    shingles (A-Z lowered, words between ASCII blanks); ``component_id`` is the smallest id reachable.
    Null and empty texts have no shingle and no link.  Rows with the same id are one document, with the
    links of each of its texts.  A row with a null id is linked with nothing: its component is null, and it is kept.
    """
    bounded_batches(docs.sparkSession)
    similarity = percent / 100
    rows = staged(sketches(docs, words, k, id_col, text_col))
    linked = rows.where("n_shingles > 0 and id is not null")
    reps = linked.groupBy("set_key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    reps = staged(reps)
    first = linked.join(reps, (linked.set_key == reps.set_key) & (linked.id == reps.rep))
    classes = staged(first.select("rep", reps.set_key, "n_shingles", "sketch").dropDuplicates(["set_key"]))
    prefixes = staged(_prefixes(classes, k, similarity))

    pairs = staged(_filtered(_hub_pairs(prefixes), classes, k, similarity))
    # An id with several texts is one document: what one of them is linked with, the others are.
    several = linked.groupBy("id").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high")).where("low <> high")
    links = linked.select("id", "set_key").join(several.select("id"), "id").join(reps, "set_key")
    links, known = staged(links.select(F.col("id").alias("a"), F.col("rep").alias("b"))), None
    for turn in (1, 2):
        if turn == 2:
            wider = lambda ids: full_sets(docs, ids, words, id_col, text_col, WIDE)
            pairs = staged(_tiled_pairs(prefixes, known, classes, wider, k, percent))
        wanted = pairs.select(F.col("a").alias("id"), F.col("key_a").alias("set_key"))
        wanted = staged(wanted.union(pairs.select("b", "key_b")).distinct())
        sets = staged(full_sets(docs, wanted, words, id_col, text_col))
        links = staged(links.union(_verified(pairs, sets, percent)))
        known = components(links)
    component = reps.join(known, reps.rep == known.node, "left")
    component = component.select("set_key", F.coalesce("root", "rep").alias("component"))
    out = rows.join(component, "set_key", "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id")
    out = out.select(F.col("id").alias(id_col), "n_shingles", own)
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
