import hashlib
import random
import re

from threatlog.llm.pii import CHUNK, personal_data, redacted, span_digests

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def _digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def _check(docs, pairs):
    found = {(r["doc_id"], r["base_sha256"]) for r in span_digests(docs(pairs)).collect()}
    assert found == {(i, _digest(brute(t))) for i, t in pairs}


def test_base_spans_are_those_of_the_patterns(docs):
    make = random.Random(6)
    pieces = list("ab1 .-+@()%_é🙂\n,") + ["10.0.0.1", "256.1.1.1", "a.b@c.d", "x@y", "..", "4111111111111111", "4111 1111-1111 1111", "+1 (366) 555-9807", "\ue000", "@b.c", "12", "0007"]
    pairs = [(i, "".join(make.choice(pieces) for _ in range(make.randint(1, 25)))) for i in range(1500)]
    pairs += [(9001, "a@b.c_d@e.f"), (9002, "1.2.3.4.5.6.7.8"), (9003, "99999999999999999999.1.1.1 1.1.1.00255"), (9004, "x@a.b.c..d e@f.g-")]
    _check(docs, pairs)


def _long(n):
    return [(1, "a" * n), (2, "1" * n), (3, "1 " * n), (4, "a." * n + "b@" + "c." * n + "d"), (5, "1." * n), (6, "+1" + "(" * n), (8, "@" * n)]


def test_long_runs_are_linear(docs):
    small = _long(300) + [(7, "1.2.3.4 " * (CHUNK * 3)), (9, "a@b.cd " * 700)]
    _check(docs, small)
    # The patterns as they stand would take hours here; what they find is known.
    n = 100_000
    expected = {i: [] for i in range(1, 9)}
    expected[4] = [("email", 0, 4 * n + 3)]
    expected[5] = [("ip", 8 * i, 8 * i + 7) for i in range(n // 4)]
    found = {(r["doc_id"], r["base_sha256"]) for r in span_digests(docs(_long(n))).collect()}
    assert found == {(i, _digest(expected[i])) for i, _ in _long(n)}


def test_odd_documents(odd, none, docs):
    rows = span_digests(odd).collect()
    expected = {(r["doc_id"], _digest(brute(r["text"]))) for r in odd.collect()}
    assert {(r["doc_id"], r["base_sha256"]) for r in rows} == expected and len(rows) == odd.count()
    assert span_digests(none).count() == 0


def _contextual():
    make = random.Random(9)
    word = lambda: "".join(make.choice("abcdefghij") for _ in range(6))
    pairs = []
    for i in range(40):
        pairs.append((i, f"{word()} {word()} Account number: 4{make.randrange(10**3):03d}-{word()} ask {word()}"))
        pairs.append((100 + i, f"{word()} {word()} contact me at {word()}@{word()}.org {word()} {word()}"))
        pairs.append((200 + i, f"{word()} {word()} version no {make.randrange(10**5):05d} {word()}"))
    pairs += [(500, "so contact me at jane4455example soon"), (501, "the version no 123456 again")]
    return pairs


def test_contexts_find_unseen_identifiers(docs):
    pairs = _contextual()
    found = {r["id"]: r for r in personal_data(docs(pairs)).collect()}
    assert [tuple(x) for x in found[500]["added"]] == [(0, 17, 32)]
    assert all(not r["added"] for i, r in found.items() if i != 500)
    spans = {r["doc_id"]: r["spans"] for r in span_digests(docs(pairs)).collect()}
    assert spans[500] == "email:17:32" and spans[501] == ""


def test_redaction(docs, odd, none):
    rows = redacted(docs([(1, "é mail a@b.c now 1.2.3.4"), (1, "é mail a@b.c now 1.2.3.4"), (2, "none"), (3, None), (4, "4111111111111111@x.y")]), length_col="n_chars")
    found = sorted((r["doc_id"], r["text"], r["n_chars"]) for r in rows.collect() if r["text"])
    assert found == [(1, "é mail [EMAIL] now [IP]", 23)] * 2 + [(2, "none", 4), (4, "[EMAIL]", 7)]
    assert rows.where("text is null").count() == 1
    assert redacted(odd).columns == odd.columns and redacted(odd).count() == odd.count()
    assert redacted(none).count() == 0
    plan = span_digests(docs([(1, "a@b.c")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_identifiers_with_blanks_are_whole_instances(docs):
    make = random.Random(4)
    word = lambda: "".join(make.choice("abcdefghij") for _ in range(6))
    digits = lambda n: f"{make.randrange(10**n):0{n}d}"
    pairs = [(i, f"{word()} {word()} ring me on +1 ({digits(3)}) {digits(3)}-{digits(4)} {word()}") for i in range(30)]
    unseen = {100: "020 7946 0958", 101: "(743) 555-3824", 102: "5551234567"}
    pairs += [(i, f"so ring me on {x}, {word()}") for i, x in unseen.items()]
    pairs += [(200, "ring me on +1 (743) 555-3824 and ring me on (743) 555-9999. 1.2.3.4 8888")]
    found = {r["id"]: r for r in personal_data(docs(pairs)).collect()}
    for i, x in unseen.items():
        assert [tuple(y) for y in found[i]["added"]] == [(3, 14, 14 + len(x))]
    text = dict(pairs)[200]
    assert [text[x["s"]:x["e"]] for x in found[200]["added"]] == ["(743) 555-9999"]
    assert all(not found[i]["added"] for i in range(30))
    # One phone, however often, is no support.
    same = [(i, f"{word()} ring me on +1 (743) 555-3824 {word()}") for i in range(30)] + [(100, "ring me on 020 7946 0958")]
    assert all(not r["added"] for r in personal_data(docs(same)).collect())


def test_contexts_reach_over_numbers(docs):
    make = random.Random(7)
    pairs = [
        (i, f"2024-01-{make.randrange(1, 29):02d} user{make.randrange(100)} +1743{make.randrange(10**7):07d} ok") for i in range(30)
    ]
    pairs.append((100, "2024-05-09 user12 tel02079460958 ok"))
    found = {r["id"]: [tuple(x) for x in r["added"]] for r in personal_data(docs(pairs)).collect()}
    assert found.pop(100) == [(3, 18, 32)] and not any(found.values())
