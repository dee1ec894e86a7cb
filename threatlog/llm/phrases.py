"""Collocations: the phrases of a language that are much more frequent than their parts let expect.

Frequent n-grams are found in two passes.  The first keeps Misra-Gries summaries of hashed n-grams: a task counts
its own, which are exact summaries; they are cut by ranges of the hash and merged, a range at a time, into one with
more counters than the range's mass divided by the threshold, so that all decrements of a counter together stay
below the threshold and **every n-gram that reaches it survives**.  It goes over words and pairs first, then over
those longer n-grams all of whose pairs survived.  Survivors become marks in a table of bits of fixed size.  The
second pass counts the marked n-grams exactly, by their words, so neither a hash nor a full table of marks can
change a result.  Scores and the phrases inside longer ones are joins of that table of counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import at_most, remove_folder, scratch_folder, staged
from .texts import bounded_batches, slices

LONGEST, THRESHOLD, BEST = 4, 30, 2000
#: Occurrences of n-grams of a range of hashes, on average; it bounds what one merging task holds.
MASS = 1 << 21
#: Occurrences that a task gathers before it adds them to its summary, counters of a summary, and of a batch of its rows.
GATHERED, COUNTERS, WRITTEN = 1 << 20, 1 << 20, 1 << 16
#: Counters of a row of a summary, at most 36 KB, and rows that are read at once.  The JVM holds a hundred rows of a file's page
#: a few times, and objects of half a megabyte take whole regions of its heap.
ROW, READ = 1 << 12, 256
#: Bytes of summaries that a task gathers before it writes them.
BLOCK_BYTES = 8 << 20
#: Bits of a hash in a summary.  Two n-grams with one hash only make survivors that the second pass drops.
HASH_BITS = 48
#: The table of marks has 2**27 bits (16 MB), whatever the input; each survivor sets two.
MARK_BITS = 27
#: Tasks that rank a language's phrases before the last one, which sees the best of each.
RANKERS = 64

_SEPARATOR = b"\xff"  # no byte of UTF-8
#: To lower case; what ends a piece becomes a line feed.
_LETTERS = bytes.maketrans(b".,;:!?\x0b\x0c\rABCDEFGHIJKLMNOPQRSTUVWXYZ", b"\n" * 9 + b"abcdefghijklmnopqrstuvwxyz")


class _Numbers(dict):
    def __missing__(self, word):
        number = self[word] = len(self)
        return number


def numbered_words(texts: list[bytes]):
    """The different words of texts, and the number of each word in order; number 0 stands between pieces."""
    import numpy as np

    numbers = _Numbers({_SEPARATOR: 0})
    words = b"\n".join(texts).translate(_LETTERS).replace(b"\n", b" " + _SEPARATOR + b" ").split()
    return numbers, np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))


def _mixed(state, value):
    import numpy as np

    x = (state ^ value) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Grams:
    """The n-grams of texts in one language: at each place their hashes, and whether they lie within a piece."""

    def __init__(self, lang: str, texts: list[bytes]):
        import numpy as np
        import xxhash

        numbers, self.ids = numbered_words(texts)
        self.words = list(numbers)
        of_word = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))
        self._seed = np.uint64(xxhash.xxh3_64_intdigest(lang.encode("utf-8"), 1))
        self._of_word, self._known = of_word[self.ids], self.ids > 0

    def sizes(self, longest: int):
        """Yield (size, hashes, whether within a piece), for sizes 1 to ``longest``."""
        import numpy as np

        if not len(self.ids):
            return
        hashes, within = _mixed(self._seed, self._of_word), self._known
        for size in range(1, longest + 1):
            if size > 1:
                hashes = _mixed(hashes[:-1], self._of_word[size - 1 :])
                within = within[:-1] & self._known[size - 1 :]
            yield size, hashes >> np.uint64(64 - HASH_BITS), within


def _places(hashes):
    """The two bits of each hash."""
    import numpy as np

    second = (hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - MARK_BITS)
    return hashes >> np.uint64(HASH_BITS - MARK_BITS), second


def _marked(marks, hashes):
    import numpy as np

    found = np.ones(len(hashes), bool)
    for places in _places(hashes):
        found &= (marks[(places >> np.uint64(6)).astype(np.int64)] >> (places & np.uint64(63))) & np.uint64(1) == 1
    return found


def packed(hashes, counts) -> bytes:
    """A summary, sorted by hash, as bytes: differences of hashes and counts, as narrow as they are."""
    import numpy as np

    steps, most = np.diff(hashes), int(counts.max())
    wide = "<u8" if len(steps) and int(steps.max()) >> 32 else "<u4"
    kind = "<u1" if most < 1 << 8 else "<u4" if most < 1 << 32 else "<i8"
    head = np.array([len(hashes), int(wide[2]), int(kind[2]), int(hashes[0])], "<i8")
    return head.tobytes() + steps.astype(wide).tobytes() + counts.astype(kind).tobytes()


def unpacked(data: bytes):
    """The hashes and counts of :func:`packed`."""
    import numpy as np

    n, wide, kind, first = np.frombuffer(data, "<i8", 4).tolist()
    hashes = np.empty(n, np.uint64)
    hashes[0] = first
    hashes[1:] = np.frombuffer(data, f"<u{wide}", n - 1, 32)
    counts = np.frombuffer(data, f"<{'i' if kind == 8 else 'u'}{kind}", n, 32 + wide * (n - 1))
    return np.cumsum(hashes, dtype=np.uint64), counts.astype(np.int64)


def combined(hashes, counts):
    """Counters with the same hash added up; sorted by hash."""
    import numpy as np

    if not len(hashes):
        return hashes, counts
    order = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    return hashes[first], np.add.reduceat(counts, first)


def shrunk(hashes, counts, capacity: int):
    """A summary of at most ``capacity`` counters, and by how much every counter was lowered.

    All are lowered by the largest count that has no room, so that each unit of it is taken from more than
    ``capacity`` counters: over any merges of a mass m, the units add up to less than m / capacity.
    """
    import numpy as np

    if len(counts) <= capacity:
        return hashes, counts, 0
    lowered = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    left = counts > lowered
    return hashes[left], counts[left] - lowered, lowered


def survivors(parts, threshold: int):
    """Hashes whose count may reach ``threshold``; ``parts`` is a list of (hashes, counts), merged one after the other."""
    import numpy as np

    capacity = sum(int(counts.sum()) for _, counts in parts) // threshold + 1
    hashes, counts, lowered, waiting, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, [], 0
    for at, part in enumerate(parts):
        waiting.append(part)
        size += len(part[0])
        # Several small summaries are merged at once.
        if at + 1 < len(parts) and size < 2 * capacity:
            continue
        hashes, counts = combined(np.concatenate([hashes, *[h for h, _ in waiting]]), np.concatenate([counts, *[c for _, c in waiting]]))
        hashes, counts, down = shrunk(hashes, counts, capacity)
        lowered, waiting, size = lowered + down, [], 0
    return hashes[counts + lowered >= threshold]


def _by_language(batch):
    """(lang, texts) of a batch of (lang, text) columns."""
    groups: dict = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast("binary").to_pylist()):
        if text:
            groups.setdefault(lang, []).append(text)
    return groups.items()


def _summaries(docs: DataFrame, marks=None) -> DataFrame:
    """Rows (summary, mass), each sorted by hash: of words and pairs, or with the marks of pairs of what is longer."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        bits = None if marks is None else np.frombuffer(marks.value, np.uint64)
        gathered, size = [], 0
        hashes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def rows():
            for at in range(0, len(hashes), WRITTEN):
                ends = range(at, min(at + WRITTEN, len(hashes)), ROW)
                summaries = [packed(hashes[a : a + ROW], counts[a : a + ROW]) for a in ends]
                masses = [int(counts[a : a + ROW].sum()) for a in ends]
                yield pa.RecordBatch.from_arrays([pa.array(summaries, pa.binary()), pa.array(masses, pa.int64())], ["summary", "mass"])

        def added():
            new, n = np.unique(np.concatenate(gathered), return_counts=True)
            return combined(np.concatenate([hashes, new]), np.concatenate([counts, n]))

        for batch in slices(batches, 1024):
            for lang, texts in _by_language(batch):
                grams = Grams(lang, texts)
                pairs = None
                for n, h, within in grams.sizes(2 if bits is None else LONGEST):
                    if bits is not None:
                        if n == 1:
                            continue
                        if n == 2:
                            pairs = within = within & _marked(bits, h)
                            continue
                        within = before[:-1] & pairs[n - 2 :] if n > 3 else pairs[:-1] & pairs[1:]
                    before = within
                    gathered.append(h[within])
                    size += len(gathered[-1])
                if size >= GATHERED:
                    hashes, counts = added()
                    gathered, size = [], 0
                    if len(hashes) >= COUNTERS:
                        yield from rows()
                        hashes, counts = hashes[:0], counts[:0]
        if gathered:
            hashes, counts = added()
        yield from rows()

    return docs.select("lang", "text").mapInArrow(run, "summary binary, mass bigint")


def _marks(docs: DataFrame, threshold: int, marks=None) -> bytes:
    """The table of bits that marks every hash whose n-gram may be frequent."""
    import numpy as np

    spark, path = docs.sparkSession, scratch_folder(docs.sparkSession)
    parts = staged(_summaries(docs, marks), path=path, block_bytes=BLOCK_BYTES)
    mass = parts.agg(F.sum("mass")).first()[0] or 0
    ranges = -(-mass // MASS) or 1
    # The first hash of each range; ranges are equally wide, so hashes fill them evenly.
    starts = np.array([(r << HASH_BITS) // ranges for r in range(1, ranges)], np.uint64).tobytes()

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        bounds = np.frombuffer(starts, np.uint64)
        for batch in slices(batches):
            numbers, summaries = [], []
            for summary in batch.column(0):
                h, c = unpacked(summary.as_py())
                # The ranges of its first and last hash, and the places where those between begin.
                first, last = np.searchsorted(bounds, h[[0, -1]], side="right").tolist()
                ends = [0, *np.searchsorted(h, bounds[first:last]).tolist(), len(h)]
                some = [(r, a, b) for r, (a, b) in enumerate(zip(ends, ends[1:]), first) if b > a]
                numbers += [r for r, _, _ in some]
                summaries += [packed(h[a:b], c[a:b]) for _, a, b in some]
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(summaries, pa.binary())], ["range", "summary"])

    def merge(table):
        import numpy as np
        import pyarrow as pa

        left = survivors([unpacked(x.as_py()) for x in table.column("summary")], threshold)
        places = np.unique(np.concatenate(_places(left)))
        words, first = np.unique(places >> np.uint64(6), return_index=True)
        ones = np.uint64(1) << (places & np.uint64(63))
        bits = np.bitwise_or.reduceat(ones, first) if len(first) else ones
        return pa.table({"word": words.astype(np.int64), "bits": bits.view(np.int64)})

    cuts = parts.select("summary").mapInArrow(cut, "range bigint, summary binary")
    merged = cuts.groupBy("range").applyInArrow(merge, "word bigint, bits bigint")
    with at_most(spark, "spark.sql.parquet.columnarReaderBatchSize", READ):
        found = merged.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most 2**(MARK_BITS - 6) rows
    remove_folder(spark, path)
    table = np.zeros(1 << (MARK_BITS - 6), np.int64)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return table.tobytes()


def _counted(docs: DataFrame, threshold: int, of_pairs, of_longer) -> DataFrame:
    """Exact counts of all n-grams that reach ``threshold``: lang, size, phrase, f; size 0 has all words of a language."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        short, long = (np.frombuffer(m.value, np.uint64) for m in (of_pairs, of_longer))
        schema = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])

        def numbered(x, y, width):
            """Numbers of pairs of numbers, and the pairs in order of their numbers."""
            keys, number = np.unique(x * width + y, return_inverse=True)
            return number, keys // width, keys % width

        for batch in batches:
            for lang, texts in _by_language(batch):
                grams = Grams(lang, texts)
                ids, words = grams.ids, grams.words
                sizes, phrases, counts = [0], [b""], [int((ids > 0).sum())]
                width = np.int64(len(words))
                for size, hashes, within in grams.sizes(LONGEST):
                    chosen = np.flatnonzero(within & _marked(short if size < 3 else long, hashes))
                    part = [ids[chosen + k] for k in range(size)]
                    # Words are told apart by their numbers, never by a hash.
                    if size == 1:
                        number, texts_of = part[0], words
                    elif size == 2:
                        number, a, b = numbered(*part, width)
                        texts_of = [words[x] + b" " + words[y] for x, y in zip(a.tolist(), b.tolist())]
                    else:
                        first, a, b = numbered(part[0], part[1], width)
                        last, c, d = numbered(part[2], part[3], width) if size == 4 else (part[2], None, None)
                        number, x, y = numbered(first, last, np.int64(max(len(words), len(chosen)) + 1))
                        ends = [words[i] for i in y.tolist()] if size == 3 else [words[c[i]] + b" " + words[d[i]] for i in y.tolist()]
                        texts_of = [words[a[i]] + b" " + words[b[i]] + b" " + end for i, end in zip(x.tolist(), ends)]
                    n = np.bincount(number, minlength=len(texts_of))
                    some = np.flatnonzero(n).tolist()
                    sizes += [size] * len(some)
                    phrases += [texts_of[i] for i in some]
                    counts += n[some].tolist()
                columns = [pa.array([lang] * len(sizes)), pa.array(sizes, pa.int32()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    found = docs.select("lang", "text").mapInArrow(run, "lang string, size int, phrase string, f bigint")
    summed = found.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))
    return summed.where((F.col("size") == 0) | (F.col("f") >= threshold))


def frequent_ngrams(docs: DataFrame, threshold=THRESHOLD, text_col="text", lang_col="lang") -> DataFrame:
    """All n-grams of 1 to 4 words with at least ``threshold`` occurrences: ``lang``, ``size``, ``phrase``, ``f``.

    A-Z are lower-cased; pieces end at ``.,;:!?`` and at line ends, words at blanks and tabs; n-grams lie within pieces,
    overlaps count.  A null language is ``und``, a null text empty.  Repeated rows all count.  Rows of size 0 have
    a language's count of words.  Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    of_pairs = spark.sparkContext.broadcast(_marks(rows, threshold))
    of_longer = spark.sparkContext.broadcast(_marks(rows, threshold, of_pairs))
    counts = staged(_counted(rows, threshold, of_pairs, of_longer))
    for marks in (of_pairs, of_longer):
        marks.destroy()
    return counts


def _scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, size, a, l, r, score of every phrase of two words or more: its lowest-scoring cut."""
    words = F.split("phrase", " ")
    phrases = counts.where("size >= 2").select("lang", "phrase", "size", F.col("f").alias("a"), words.alias("w"))
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    piece = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    sides = F.array(
        F.struct(F.lit(True).alias("left"), piece(F.lit(1), F.col("k")).alias("part")),
        F.struct(F.lit(False).alias("left"), piece(F.col("k") + 1, F.col("size") - F.col("k")).alias("part")),
    )
    parts = cuts.select("lang", "phrase", "size", "a", "k", F.inline(sides))
    # A part occurs wherever its phrase does, so it is in the table.
    known = counts.where("size between 1 and 3").select("lang", F.col("phrase").alias("part"), "f")
    of_cut = parts.join(known, ["lang", "part"]).groupBy("lang", "phrase", "size", "a", "k").agg(
        F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r")
    )
    # Whole decimals: exact beyond 64 bits.
    score = F.expr("(cast(a as decimal(20, 0)) * 2000000) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    lowest = of_cut.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, threshold=THRESHOLD, best=BEST, text_col="text", lang_col="lang") -> DataFrame:
    """Each language's ``best`` phrases of 2 to 4 words: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    Of :func:`frequent_ngrams`; ``a`` is the phrase's count, ``l`` and ``r`` those of the parts at its lowest-scoring cut,
    ``n`` the words of the language.  Phrases inside a longer one that is at least 0.8 times as frequent are left out.
    Order: score and ``a`` descending, phrase ascending by bytes.  Nothing frequent, or no rows: no rows.
    """
    counts = frequent_ngrams(docs, threshold, text_col, lang_col)
    scored = _scored(counts)
    longer = counts.where("size >= 3").select("lang", "size", "f", F.split("phrase", " ").alias("w"))
    inside = longer.select("lang", "size", "f", "w", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    inside = inside.select("lang", "f", "w", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("i"))
    inside = inside.select("lang", F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("phrase"), "f")
    most = inside.groupBy("lang", "phrase").agg(F.max("f").alias("_longer"))
    times = lambda n, c: F.lit(n).cast("decimal(3,0)") * F.col(c).cast("decimal(20,0)")
    own = scored.join(most, ["lang", "phrase"], "left").where(F.col("_longer").isNull() | (times(100, "_longer") < times(80, "a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = own.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(RANKERS)))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= best)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= best)
    totals = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
