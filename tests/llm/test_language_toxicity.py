import random
from collections import Counter

import numpy as np

from threatlog.llm.language import PROFILE, learn_profiles, predict_languages, profile_of
from threatlog.llm.queries import op1_language, op2_toxicity
from threatlog.llm.toxicity import fit_linear, learn_chain, predict_chain, toxicity, without_toxic

SF = "/root/testdata/sf0.01"


def _slow_profile(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    counts = Counter()
    for word in words:
        counts.update(word)
        padded = f" {word} "
        counts.update(padded[i : i + 2] for i in range(len(padded) - 1))
        counts.update(padded[i : i + 3] for i in range(len(padded) - 2))
    # A blank between two words is one n-gram's end and the next one's start, as it is padded on both sides.
    code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    return [code(g) for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[:PROFILE]]


def test_profile_is_the_counted_one():
    make = random.Random(2)
    for _ in range(50):
        text = "".join(make.choice("abcdé ñÑ.,1\n日") for _ in range(make.randint(1, 200)))
        slow, fast = _slow_profile(text), profile_of(text)
        assert slow == ([] if fast is None else fast.tolist()), repr(text)


def test_held_out_languages(spark):
    found = op1_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = found.collect()
    assert {r["held_out"] for r in rows} == {True, False}
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_languages(odd, none, docs):
    profiles = learn_profiles(docs([(i, "the cat sat on the mat") for i in range(5)]))
    found = {(r["doc_id"], r["lang_pred"]) for r in predict_languages(odd, profiles, keep=odd.columns).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (-10, "und"), (4, "en"), (None, "en")} <= found
    clash = predict_languages(odd, profiles, keep=("doc_id", "score"))
    assert clash.columns == ["doc_id", "score", "lang_pred", "_score"]
    assert learn_profiles(none).count() == 0
    assert {r["lang_pred"] for r in predict_languages(odd, learn_profiles(none)).collect()} == {"und"}
    assert predict_languages(none, profiles).count() == 0


def test_ties_go_to_the_first_language(docs, spark):
    both = docs([(1, "abc abc")], "zz").union(docs([(2, "abc abc")], "aa"))
    assert [r["lang_pred"] for r in predict_languages(docs([(3, "abc")]), learn_profiles(both)).collect()] == ["aa"]


def test_linear_model_finds_the_optimum():
    make = np.random.default_rng(1)
    dense = (make.random((200, 5)) < 0.4).astype(float)
    y = (make.random(200) < 1 / (1 + np.exp(-(dense @ [2, -1, 0, 1, -2])))).astype(float)
    rows, columns = np.nonzero(dense)
    weights = fit_linear(rows, columns, np.ones(len(rows)), y, 5, penalty=1.0, steps=3000)
    error = 1 / (1 + np.exp(-(dense @ weights[:5] + weights[5]))) - y
    assert np.abs(dense.T @ error + weights[:5]).max() < 1e-3 and abs(error.sum()) < 1e-3


def test_chain_passes_probabilities_on(docs, spark):
    make = random.Random(4)
    words = ["w" + "".join(make.choice("abcdefgh") for _ in range(6)) for _ in range(60)]
    texts, labels = [], []
    for i in range(400):
        first, second = make.random() < 0.5, make.random() < 0.3
        text = " ".join(make.choice(words) for _ in range(20)) + " badword" * first + " vileterm" * second
        texts.append((i, text))
        labels.append((i, first, first and second))
    labels = spark.createDataFrame(labels, "doc_id bigint, a boolean, b boolean")
    chain = learn_chain(docs(texts), labels, ("a", "b"))
    assert [len(w) for w in chain["weights"]] == [len(chain["features"]) + 1, len(chain["features"]) + 2]
    assert chain["weights"][1][len(chain["features"])] > 0  # the second model leans on the first one's probability
    plain = " ".join(words[:20])
    rows = docs([(1, f"{plain} badword vileterm"), (2, f"{plain} badword"), (3, None), (4, plain)])
    found = {r["doc_id"]: r for r in predict_chain(rows, chain, ("a", "b")).collect()}
    assert found[1]["b"] > 0.5 > found[2]["b"] and found[2]["a"] > 0.5 > found[4]["a"] and found[3]["a"] == found[3]["b"] == 0


def test_toxic_documents_of_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = {r["doc_id"]: r for r in toxicity(docs, labels.where("doc_id % 4 <> 0")).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.where("doc_id % 4 = 0").collect()}
    hit = sum(found[i]["toxic"] for i, t in truth.items() if t)
    wrong = sum(found[i]["toxic"] for i, t in truth.items() if not t)
    assert hit / sum(truth.values()) > 0.9 and wrong <= 2


def test_odd_toxicity(odd, none, spark):
    labels = spark.createDataFrame([(5, 1, 0), (6, None, 1), (None, 1, 1), (9, 0, 1), (9, 0, 1)], "doc_id bigint, quality int, toxic int")
    assert toxicity(odd, labels).count() == odd.count()
    assert without_toxic(odd, labels.limit(0)).count() == odd.count()
    assert without_toxic(odd, labels.limit(0)).columns == odd.columns
    assert toxicity(none, labels).count() == 0


def test_registered_toxicity(spark):
    assert op2_toxicity(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
