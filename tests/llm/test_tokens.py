import hashlib
import random
import zlib
from array import array

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from threatlog.llm import bytelevel, packing
from threatlog.llm.bpe import BytePairCoder, bpe_digests, bpe_encode
from threatlog.llm.packing import Tokens, cut, differencing, pack, windows
from threatlog.llm.token_counts import TokenCounter, count_tokens, frequent_pretokens

WORD, BYTE = map(bytelevel.vocabulary, ("word_bpe_49k.json", "byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    word, byte = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
    return (lambda t: word.encode(t or "", add_special_tokens=False).ids), word, (lambda t: len(byte.encode(t or "", add_special_tokens=False).ids))


def _texts(n):
    make = random.Random(7)
    letters = list("abcdeisthn  \n\t'’.,!?0123456789<|>_éüßÉñΣσςİıǅ日本語한국어🙂👍🏽ﬁK½²Ⅷ٣\x1c\x85­́") + ["<|endoftext|>", "'s", "'LL", " the", "ΟΔΟΣ "]
    for i in range(n):
        if i % 4:
            yield "".join(make.choice(letters) for _ in range(make.randint(0, 30)))
        else:
            spans = [(0, 0x2FF), (0x370, 0x1FFF), (0x2000, 0xD7FF), (0xE000, 0x1FFFF)]
            yield "".join(chr(make.randint(*make.choice(spans))) for _ in range(make.randint(0, 12)))


def test_same_as_the_library(library):
    ids, word, count = library
    coder, tokens, counter = BytePairCoder(WORD), Tokens(WORD), TokenCounter(BYTE)
    for text in _texts(4000):
        expected = ids(text)
        encoded = coder.encode(text)
        assert list(array("I", encoded)) == expected, repr(text)
        assert coder.decode(encoded) == word.decode(expected, skip_special_tokens=False)
        assert list(array("I", tokens.encode(text, 2))) == [*expected, 2]
        assert counter.count(text) == count(text), repr(text)


def test_a_very_long_pretoken(library):
    ids, _, _ = library
    text = "ab" * 60_000 + "é" * 3000
    assert list(array("I", BytePairCoder(WORD).encode(text))) == ids(text)


def test_bounded_cache_is_emptied(library):
    ids, _, _ = library
    coder = BytePairCoder(WORD)
    coder._encoded._limit = coder._merged._limit = 3
    text = "the cat sat on the mat, the dog on the log"
    assert list(array("I", coder.encode(text))) == ids(text)
    assert len(coder._encoded) <= 3


def test_bpe_rows(odd, none, library):
    ids, word, _ = library
    texts = {(r["doc_id"], r["text"]) for r in odd.collect()}
    found = bpe_encode(odd).collect()
    assert len(found) == odd.count()
    pairs = {(r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in found}
    assert pairs == {(i, tuple(ids(t)), word.decode(ids(t), skip_special_tokens=False)) for i, t in texts}
    digests = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe_digests(odd).collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert digests == {(i, len(t), sha(array("I", t).tobytes()), sha(d.encode())) for i, t, d in pairs}
    assert bpe_encode(none).count() == bpe_digests(none).count() == 0


def test_token_counts(odd, none, library):
    _, _, count = library
    found = sorted(map(tuple, count_tokens(odd, limit=5).collect()), key=repr)
    rows = [(r["doc_id"], len((r["text"] or "").encode()), count(r["text"])) for r in odd.collect()]
    assert found == sorted([(*r, r[2] > 5) for r in rows], key=repr)
    assert count_tokens(none).count() == 0


def test_frequent_pretokens_are_those_of_all_texts(docs, library):
    table = {r[0]: r[1] for r in frequent_pretokens(docs([(i, f"the cat{i} the dog") for i in range(50)])).collect()}
    assert {" the", "the", " dog"} <= set(table)
    assert all(n == library[2](w) for w, n in table.items())


def test_differencing_and_windows():
    window, sums = differencing([8, 7, 6, 5, 4], 2)
    assert sorted(sums) == [14, 16]  # the known result of differencing for these numbers
    assert [sum(x for x, w in zip([8, 7, 6, 5, 4], window) if w == k) for k in (0, 1)] == sums
    make = random.Random(3)
    lengths = [make.randint(1, 1024) for _ in range(900)]
    found = windows(lengths)
    sums = [sum(x for x, w in zip(lengths, found) if w == k) for k in range(max(found) + 1)]
    assert max(sums) <= 4096 and min(sums) > 4000
    assert windows([]) == []
    assert sorted(windows([4095, 4095, 2])) == [0, 1, 2]


def test_pack_covers_every_id_once(odd, none, library):
    ids, _, _ = library
    found = [r.asDict() for r in pack(odd).collect()]
    windows_ = {}
    for r in found:
        windows_.setdefault(r["sequence_id"], []).append(r)
    for rows in windows_.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    expected = []
    for r in odd.collect():
        of = array("I", [*ids(r["text"]), 2]).tobytes()
        expected += [(r["doc_id"], s, n, c, len(of) // 4) for s, n, c in cut(of)]
        pieces = cut(of)
        assert sum(n for _, n, _ in pieces) == len(of) // 4
        assert all(c == zlib.crc32(of[4 * s : 4 * (s + n)]) for s, n, c in pieces)
    assert sorted(expected, key=repr) == sorted([(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in found], key=repr)
    assert pack(none).count() == 0


def test_equal_rows_are_spread(spark, docs, monkeypatch):
    """Equal documents go to many groups: none grows with the copies."""
    n = 20_000
    text = "the cat sat on the mat " * 50
    rows = spark.range(n).selectExpr("7L as doc_id", f"'{text}' as text")
    windows_ = pack(rows).groupBy("sequence_id").agg(F.sum("length").alias("tokens"), F.count("*").alias("pieces"))
    group = F.expr("sequence_id div 4294967296").alias("g")
    sizes = windows_.groupBy(group).agg(F.sum("pieces").alias("pieces"), F.max("tokens").alias("tokens")).collect()
    assert sum(r["pieces"] for r in sizes) == n and max(r["tokens"] for r in sizes) <= 4096
    assert len(sizes) == n // packing.GROUP and max(r["pieces"] for r in sizes) < 1.3 * packing.GROUP
