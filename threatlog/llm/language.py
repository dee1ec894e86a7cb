"""Language identification by rank-order profiles.

A profile is the list of a text's most frequent letter n-grams, the most frequent first.  A document is
given the language from whose profile its own is the least out of place: the sum, over the document's
n-grams, of how many ranks each is away from its rank there, or the most possible where it is missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytelevel import kept_in_worker
from .texts import bounded_batches, with_text_columns

#: N-grams of a profile, and their longest length.
PROFILE, LONGEST = 300, 3
#: Labelled documents, expected number per language, from which profiles are learned; chosen by a hash of text.
TRAINING = 1500
#: Languages that are learned at most, the most frequent first; bounds the profiles (LANGUAGES * PROFILE rows).
LANGUAGES = 256
UNKNOWN = "und"

_BLANK = 32


def _letters():
    """For each code point: itself if it is a letter, else a blank."""
    import numpy as np

    table = np.full(0x110000, _BLANK, np.uint32)
    for point in range(0x110000):
        if chr(point).isalpha():
            table[point] = point
    return table


def _grams(text: str):
    """The codes of all n-grams of a text's words, a blank before and behind each word; None without letters."""
    import numpy as np

    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    points = kept_in_worker("letters", _letters)[points]
    blank = points == _BLANK
    keep = np.ones(len(points) + 2, bool)
    keep[1:-1] = ~blank
    # Of several blanks in a row the first stays.
    keep[1:-1][1:] |= blank[1:] & ~blank[:-1]
    padded = np.full(len(points) + 2, _BLANK, np.int64)
    padded[1:-1] = points
    points = padded[keep]
    blank = points == _BLANK
    if blank.all():
        return None
    first, second, third = points, points[1:], points[2:]
    pairs, triples = (first[:-1] << 21) | second, (first[:-2] << 42) | (second[:-1] << 21) | third
    return np.concatenate(
        [first[~blank], pairs[~(blank[:-1] & blank[1:])], triples[~blank[1:-1]]]
    )


def profile_of(text: str, size: int = PROFILE):
    """Codes of a text's most frequent n-grams by falling count, then code; None without letters."""
    import numpy as np

    grams = _grams(text)
    if grams is None:
        return None
    codes, counts = np.unique(grams, return_counts=True)
    return codes[np.lexsort((codes, -counts))[:size]]


def learn_profiles(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", training=TRAINING, size=PROFILE):
    """Rows ``lang``, ``rank`` (from 0), ``gram`` of the profiles, learned from the labelled ``docs``.

    Rows with a null language or text teach nothing.  Of each language about ``training`` documents are
    taken by a hash of their text (all, if there are fewer); their whole texts are counted.
    """
    bounded_batches(docs.sparkSession)
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    labelled = labelled.where("lang is not null and text is not null")
    sizes = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return docs.sparkSession.createDataFrame([], "lang string, rank int, gram bigint")
    # A hash in [0, 1) against each language's share.
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, training / r["count"])))])
    place = F.pmod(F.xxhash64("text", "id"), F.lit(1_000_003)) / 1_000_003
    chosen = labelled.where(place < share[F.col("lang")])

    def count(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            by = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                grams = _grams("\n".join(texts))
                if grams is not None:
                    codes, counts = np.unique(grams, return_counts=True)
                    columns = [pa.array([lang] * len(codes)), pa.array(codes), pa.array(counts)]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "n"])

    counted = chosen.select("text", "lang").mapInArrow(count, "lang string, gram bigint, n bigint")
    summed = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # The n-grams of a language are few (its letters to the third power at most), whatever the input.
    best = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "gram")))
    top = summed.groupBy("lang").agg(F.slice(best, 1, size).alias("best"))
    return top.select("lang", F.posexplode("best").alias("rank", "of")).select("lang", "rank", F.col("of.gram").alias("gram"))


def predict_languages(docs: DataFrame, profiles: DataFrame, text_col="text", keep=("doc_id",)) -> DataFrame:
    """One row per document: the columns of ``keep``, then ``lang_pred``, ``score``.

    ``score`` is one less the out-of-place distance as a share of the largest possible.  A text that is
    null or has no letter is ``und`` with score 0, and so is every text if no profile is given.  Equal
    distances go to the language first in the alphabet.  Only the text is looked at.  Where ``keep`` has
    one of the two names, the new column's has an underscore before it.
    """
    rows = profiles.collect()
    langs = sorted({r["lang"] for r in rows})
    known = docs.sparkSession.sparkContext.broadcast([(langs.index(r["lang"]), r["rank"], r["gram"]) for r in rows])

    def predictor():
        import numpy as np
        import pyarrow as pa

        place, rank, gram = np.array(known.value or [(0, 0, 0)], np.int64).T
        grams, at = np.unique(gram, return_inverse=True)
        # Rank of each known n-gram in each language; the last row is for unknown ones.
        ranks = np.full((len(grams) + 1, max(1, len(langs))), -1, np.int64)
        ranks[at, place] = rank

        def predict(texts):
            names, scores = [], []
            for text in texts:
                own = profile_of(text.as_py() or "") if langs else None
                if own is None:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                found = np.searchsorted(grams, own)
                found[found == len(grams)] = 0
                found = np.where(grams[found] == own, found, len(grams))
                there = ranks[found]
                away = np.where(there < 0, PROFILE, np.abs(there - np.arange(len(own))[:, None])).sum(0)
                best = int(away.argmin())
                names.append(langs[best])
                scores.append(max(0.0, 1 - float(away[best]) / (PROFILE * len(own))))
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

        return predict

    return with_text_columns(docs, predictor, {"lang_pred": "string", "score": "double"}, text_col, keep)
