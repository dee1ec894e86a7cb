"""Toxicity by a classifier chain.

The categories are predicted one after the other, each by a linear model over the words of a text and
the probabilities of the categories before it.  In training those probabilities come from models that
have not seen the document (out of fold), as they will in use.

The models are fitted on a bounded sample of labelled documents (:data:`TRAINING`), every document is
predicted from its whole text.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .bytelevel import BoundedCache
from .texts import bounded_batches, with_text_columns

#: Labelled documents, expected number, on which the chain is fitted; chosen by a hash of id and text.
TRAINING = 12_000
#: Features per category, and the fewest documents of the sample that hold one.
FEATURES, FEWEST = 1000, 8
FOLDS = 3
#: Words whose features a worker keeps.
CACHED = 200_000

_WORDS, _WORD = re.compile(r"[^\W\d_]+").findall, re.compile(r"[^\W\d_]").search


def word_features(word: str) -> tuple[int, ...]:
    """A word and its first five and four letters as 32-bit hashes: inflected forms share the shorter ones."""
    out = [zlib.crc32(b"w" + word.encode("utf-8"))]
    out += [zlib.crc32(b"%d" % n + word[:n].encode("utf-8")) for n in (4, 5) if len(word) >= n]
    return tuple(out)


def text_features(text: str, of_word=word_features) -> set[int]:
    """The features that a text holds, however often."""
    found = set()
    for word in set(_WORDS(text.lower())):
        found.update(of_word(word))
    return found


def fit_linear(rows, columns, values, y, width: int, penalty: float = 0.3, steps: int = 100):
    """Weights (the last is the bias) of a logistic model over sparse rows, by accelerated gradient steps."""
    import numpy as np

    n = len(y)
    rows, columns, values = np.r_[rows, np.arange(n)], np.r_[columns, np.full(n, width)], np.r_[values, np.ones(n)]
    # As no value is negative, a column's curvature is at most a quarter of its values times their row sums.
    row_sums = np.bincount(rows, values, n)
    bound = 0.25 * np.bincount(columns, values * row_sums[rows], width + 1) + penalty
    weights, ahead = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        z = np.bincount(rows, values * ahead[columns], n)
        error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        slope = np.bincount(columns, values * error[rows], width + 1)
        slope[:-1] += penalty * ahead[:-1]
        after = ahead - slope / bound
        ahead, weights = after + (step - 1) / (step + 2) * (after - weights), after
    return weights


def _predict(rows, columns, values, weights, n):
    import numpy as np

    z = np.bincount(rows, values * weights[columns], n) + weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_chain(features: list, labels, fold, categories: int, width: int):
    """Weights of each category: over ``width`` features, the probabilities of the categories before, and a bias."""
    import numpy as np

    n = len(features)
    rows = np.repeat(np.arange(n), [len(f) for f in features])
    columns = np.concatenate([np.asarray(f, np.int64) for f in features] or [np.zeros(0, np.int64)])
    values, chain = np.ones(len(rows)), []
    for category in range(categories):
        y, size = labels[:, category].astype(float), width + category
        before = np.zeros(n)
        for k in range(FOLDS):
            train, test = fold != k, fold == k
            number = np.cumsum(train) - 1
            use = train[rows]
            if not train.any():
                continue
            weights = fit_linear(number[rows[use]], columns[use], values[use], y[train], size)
            out = test[rows]
            before[test] = _predict(rows[out], columns[out], values[out], weights, n)[test]
        chain.append(fit_linear(rows, columns, values, y, size))
        # The probability that a model without this document gives becomes a feature of the next ones.
        rows, columns = np.r_[rows, np.arange(n)], np.r_[columns, np.full(n, size)]
        values = np.r_[values, before]
    return chain


def learn_chain(docs: DataFrame, labels: DataFrame, categories: tuple, id_col="doc_id", text_col="text", training=TRAINING):
    """The chain as a small dictionary: ``features`` (hash to number) and ``weights`` per category.

    ``categories`` are boolean columns of ``labels`` in the order of the chain.  Documents without a
    label, null labels, null texts, and all but the first of several labels of a document teach nothing.
    """
    bounded_batches(docs.sparkSession)
    whole = [F.col(c).isNotNull() for c in categories]
    marks = [F.col(c).cast("int").alias(f"y{i}") for i, c in enumerate(categories)]
    known = labels.select(F.col(id_col).alias("id"), *marks, *[w.alias(f"w{i}") for i, w in enumerate(whole)])
    known = known.where(" and ".join(["id is not null", *[f"w{i}" for i in range(len(categories))]]))
    known = known.groupBy("id").agg(*[F.min(f"y{i}").alias(f"y{i}") for i in range(len(categories))])
    count = max(1, known.count())
    # Labels are narrow: those chosen, of bounded number, meet the texts.
    chosen = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003 < training / count)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    sample = texts.join(F.broadcast(chosen), "id")
    fold = F.pmod(F.xxhash64("text", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold")
    y = F.array(*[F.col(f"y{i}") for i in range(len(categories))]).alias("y")

    def extract(batches):
        import pyarrow as pa

        of_word = BoundedCache(word_features, CACHED).__getitem__
        for batch in batches:
            found = [list(text_features(x.as_py(), of_word)) for x in batch.column(2)]
            features = pa.array(found, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), features], ["y", "fold", "features"])

    rows = sample.select(y, fold, "text").mapInArrow(extract, "y array<int>, fold int, features array<bigint>")
    rows = staged(rows)
    totals = rows.agg(F.count("*").alias("n"), *[F.sum(F.col("y")[i]).alias(f"n{i}") for i in range(len(categories))]).first()
    if not totals["n"]:
        return {"features": {}, "weights": [[-40.0]] * len(categories)}
    held = rows.select(F.explode("features").alias("feature"), "y").groupBy("feature")
    held = held.agg(F.count("*").alias("n"), *[F.sum(F.col("y")[i]).alias(f"n{i}") for i in range(len(categories))])
    held = held.where(F.col("n") >= FEWEST)
    best = None
    for i in range(len(categories)):
        # How far its share of positive documents is from the whole sample's, in standard deviations.
        share = totals[f"n{i}"] / totals["n"]
        far = F.abs(F.col(f"n{i}") - F.col("n") * share) / F.sqrt(F.col("n") * max(share * (1 - share), 1e-9))
        top = held.select("feature", far.alias("far")).orderBy(F.desc("far"), "feature").limit(FEATURES).select("feature")
        best = top if best is None else best.union(top)
    numbers = {r[0]: i for i, r in enumerate(best.distinct().orderBy("feature").collect())}
    width = len(numbers)

    def narrow(batches):
        import pyarrow as pa

        for batch in batches:
            used = [[numbers[f] for f in row if f in numbers] for row in batch.column(2).to_pylist()]
            features = pa.array(used, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), features], ["y", "fold", "features"])

    def fit(_, table):
        import numpy as np
        import pyarrow as pa

        y = np.array(table.column("y").to_pylist())
        features = [x.values.to_numpy() for x in table.column("features")]
        chain = fit_chain(features, y, table.column("fold").to_numpy(), len(categories), width)
        return pa.table({"category": pa.array(range(len(categories)), pa.int32()), "weights": [w.tolist() for w in chain]})

    # One task fits the chain: the sample is bounded, whatever the input.
    narrowed = rows.mapInArrow(narrow, "y array<int>, fold int, features array<bigint>")
    fitted = narrowed.groupBy(F.lit(0).alias("all")).applyInArrow(fit, "category int, weights array<double>").collect()
    return {"features": numbers, "weights": [r["weights"] for r in sorted(fitted)]}


def predict_chain(docs: DataFrame, chain: dict, names: tuple, text_col="text", keep=("doc_id",)) -> DataFrame:
    """One row per document: the columns of ``keep``, then one probability column per name of ``names``.

    A text that is null or without words has probability 0 of everything.
    Where ``keep`` has one of the names, the new column's has an underscore before it.
    """
    model = docs.sparkSession.sparkContext.broadcast(chain)

    def predictor():
        import numpy as np
        import pyarrow as pa

        numbers, weights = model.value["features"], [np.array(w) for w in model.value["weights"]]
        known = lambda word: tuple(numbers[f] for f in word_features(word) if f in numbers)
        of_word = BoundedCache(known, CACHED).__getitem__

        def predict(texts):
            out = [[] for _ in names]
            for text in texts:
                text, before = text.as_py() or "", []
                if not _WORD(text):
                    for probabilities in out:
                        probabilities.append(0.0)
                    continue
                held = list(text_features(text, of_word))
                for category, w in enumerate(weights):
                    z = w[held].sum() + w[-1] + sum(p * v for p, v in zip(before, w[len(numbers) :]))
                    before.append(float(1 / (1 + np.exp(-np.clip(z, -40, 40)))))
                    out[category].append(before[-1])
            return [pa.array(x, pa.float64()) for x in out]

        return predict

    return with_text_columns(docs, predictor, {name: "double" for name in names}, text_col, keep)


def toxicity(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", threshold=0.3) -> DataFrame:
    """One row per document: id, ``p_low_quality``, ``p_toxic``, ``toxic`` (boolean).

    The chain is low quality, then toxic, learned from ``labels`` (quality 0/1, toxic 0/1).  Without
    labels nothing is toxic.  Held-out clean documents stay far below the threshold (see the README).  Equal rows and
    rows with one id give a row each, by their own text; a null id stays null.
    """
    chain = learn_toxicity(docs, labels, id_col, text_col)
    scored = predict_chain(docs, chain, ("p_low_quality", "p_toxic"), text_col, (id_col,))
    return scored.withColumn("toxic", F.col("p_toxic") >= threshold)


def without_toxic(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", threshold=0.3) -> DataFrame:
    """``docs`` without the rows that :func:`toxicity` calls toxic."""
    chain = learn_toxicity(docs, labels, id_col, text_col)
    scored = predict_chain(docs, chain, ("p_low_quality", "p_toxic"), text_col, docs.columns)
    return scored.where(F.col(scored.columns[-1]) < threshold).select(*docs.columns)


def learn_toxicity(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text") -> dict:
    """The chain low quality, toxic."""
    marks = labels.select(id_col, (F.col("quality") == 0).alias("low"), (F.col("toxic") == 1).alias("toxic"))
    return learn_chain(docs, marks, ("low", "toxic"), id_col, text_col)
