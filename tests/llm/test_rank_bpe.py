import base64
import hashlib
import random

import public_tokenizers
import pytest
import regex

from threatlog.llm import rank_bpe
from threatlog.llm.bytelevel import vocabulary
from threatlog.llm.rank_bpe import RankCoder, decode_ids, encode_texts, encoding_digests, parts

PATH = vocabulary("byte_bpe_multi_50k.tiktoken")
#: The pattern with the library's meaning of a blank.
PATTERN = public_tokenizers.PATTERN.replace(r"[^\s", f"[^{rank_bpe.WHITE}").replace(r"\S", f"[^{rank_bpe.WHITE}]").replace(r"\s", f"[{rank_bpe.WHITE}]")


@pytest.fixture(scope="module")
def plain():
    """Byte-pair encoding by definition: the adjacent pair of least rank is merged, leftmost first."""
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}

    def encode(text):
        ids = []
        for match in regex.findall(PATTERN, text or ""):
            units = [bytes([b]) for b in match.encode()]
            while len(units) > 1:
                found = [(ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(units, units[1:]))]
                rank, i = min(found)
                if rank == 1 << 30:
                    break
                units[i : i + 2] = [units[i] + units[i + 1]]
            ids += [ranks[u] for u in units]
        return ids

    return encode


@pytest.fixture(scope="module")
def coder():
    return RankCoder(PATH)


LETTERS = list("abst  \n\t'’.,!?019<|>_éßÑσ日本語한🙂👍🏽ﬁ½²́ 　\x85\x1c") + ["<|endoftext|>", "'s", "'ll", " the", "   "]


def _texts(n, seed=11, longest=40):
    make = random.Random(seed)
    for _ in range(n):
        yield "".join(make.choice(LETTERS) for _ in range(make.randint(0, longest)))


def test_same_as_the_definition(plain, coder):
    for text in _texts(1500):
        ids = coder.encode(text)
        assert ids == plain(text), repr(text)
        assert coder.decode(ids) == text.encode()


@pytest.mark.parametrize("part, blanks", [(1, 2), (3, 4), (10, 3)])
def test_parts_end_where_matches_end(part, blanks):
    for text in _texts(1500, seed=part, longest=60):
        pieces = list(parts(text, part, blanks))
        assert "".join(p for p, _ in pieces) == text
        cut = []
        for piece, whole in pieces:
            cut += [piece] if whole else regex.findall(PATTERN, piece)
        assert cut == regex.findall(PATTERN, text), repr(text)


@pytest.mark.parametrize(
    "text", ["\n" * 3_000_000 + "x", "a" + " " * 2_000_000, "x" * 300_000, "ab1! " * 100_000, "日本" * 50_000, "\n \t" * 50_000 + " y"]
)
def test_very_long_texts(coder, text):
    ids = coder.encode(text)
    assert coder.decode(ids) == text.encode()
    if len(text) < 200_000:
        assert ids == coder._library.encode_ordinary(text)


def test_a_long_text_is_cut_and_stays_the_same(coder):
    text = " ".join(_texts(6000, seed=3))
    assert len(list(parts(text))) > 1
    assert coder.encode(text) == coder._library.encode_ordinary(text)


def test_rows(odd, none, coder, plain):
    rows = odd.collect()
    expected = sorted(((r["doc_id"], tuple(coder.encode(r["text"] or ""))) for r in rows), key=repr)
    encoded = encode_texts(odd)
    assert sorted(((r["doc_id"], tuple(r["ids"])) for r in encoded.collect()), key=repr) == expected
    decoded = sorted(((r["doc_id"], bytes(r["decoded"])) for r in decode_ids(encoded).collect()), key=repr)
    assert decoded == sorted(((r["doc_id"], (r["text"] or "").encode()) for r in rows), key=repr)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    digests = sorted((tuple(r) for r in encoding_digests(odd).collect()), key=repr)
    texts = [(r["doc_id"], coder.encode(r["text"] or ""), (r["text"] or "").encode()) for r in rows]
    assert digests == sorted(((i, len(t), sha(",".join(map(str, t)).encode()), sha(b)) for i, t, b in texts), key=repr)
    assert [encode_texts(none).count(), encoding_digests(none).count(), decode_ids(encode_texts(none)).count()] == [0, 0, 0]


def test_half_a_character_and_null_ids(spark, coder):
    first = coder.encode("🙂")
    rows = spark.createDataFrame([(1, first[:1], "x"), (2, None, "x"), (3, [], "x"), (4, [first[0], None], None)], "doc_id bigint, ids array<int>, id string")
    found = {r["doc_id"]: bytes(r["decoded"]) for r in decode_ids(rows).collect()}
    assert found == {1: coder.decode(first[:1]), 2: b"", 3: b"", 4: coder.decode(first[:1])}
    assert rank_bpe.PART > rank_bpe.BLANKS
