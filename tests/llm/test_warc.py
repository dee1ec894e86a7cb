import base64
import gzip
import hashlib
import random

from threatlog.llm.warc import END, archived_pages, digest, read_archives, record, salvage, write_archives

PAGES = "page_id bigint, url string, html string, id string, payload string, n int, refers_to string"


def _pages(spark, pairs):
    return spark.createDataFrame([(i, "u", h, "x", "y", 1, "z") for i, h in pairs], PAGES)


def _expected(pairs):
    last = {}
    for i, h in pairs:
        if i is not None:
            last[h or ""] = max(i, last.get(h or "", i))
    out = []
    for i, h in pairs:
        body = (h or "").encode()
        revisit = i is not None and i != last[h or ""]
        said = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((i, len(body), said, "revisit" if revisit else "response", last[h or ""] if revisit else None))
    return sorted(out, key=repr)


def test_pages_go_round(spark, tmp_path):
    pairs = [(i, f"<p>{i % 7}</p>") for i in range(60)]
    pairs += [(100, None), (101, ""), (102, "é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (103, "x" * 300_000)]
    pairs += [(104, "twice"), (104, "twice"), (None, "twice"), (-5, "twice"), (105, "\x00﻿\x1f🙂")]
    found = archived_pages(_pages(spark, pairs), str(tmp_path / "a")).collect()
    assert sorted(map(tuple, found), key=repr) == _expected(pairs)
    assert archived_pages(_pages(spark, []), str(tmp_path / "b")).count() == 0


def test_files_are_plain_warc(spark, tmp_path):
    write_archives(_pages(spark, [(1, "a"), (2, "b")]), str(tmp_path / "a"))
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "a").rglob("part-*")))
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: ") and data.endswith(END)
    assert [x[0] for x in salvage(data)] == ["record", "record"]


def _plain(n):
    return [record(i, f"body {i} {'z' * i}".encode(), digest(f"body {i} {'z' * i}".encode())) + END for i in range(n)]


def _ids(found):
    return [int(x[2]["warc-record-id"][10:-1]) for x in found if x[0] == "record"]


def test_salvage_after_damage():
    parts = _plain(6)
    starts = [sum(map(len, parts[:i])) for i in range(7)]
    hurt = bytearray(b"".join(parts))
    hurt[starts[2] + 300 : starts[2] + 303] = b"???"  # in a block or header: the digest or a header line fails
    found = list(salvage(bytes(hurt)))
    assert _ids(found) == [0, 1, 3, 4, 5]
    assert [(x[1], x[2]) for x in found if x[0] == "gap"] == [(starts[2], starts[3])]
    cut_off = b"".join(parts)[: starts[5] + 40]
    found = list(salvage(cut_off))
    assert _ids(found) == [0, 1, 2, 3, 4] and found[-1][:3] == ("gap", starts[5], len(cut_off))
    assert list(salvage(b"")) == []
    assert [x[:3] for x in salvage(b"no archive")] == [("gap", 0, 10)]


def test_salvage_of_members():
    members = [gzip.compress(x) for x in _plain(5)]
    found = list(salvage(b"".join(members)))
    assert _ids(found) == [0, 1, 2, 3, 4]
    hurt = bytearray(b"".join(members))
    at = len(members[0])
    hurt[at + 20] ^= 0xFF
    found = list(salvage(bytes(hurt)))
    assert _ids(found) == [0, 2, 3, 4]
    assert [x[1:3] for x in found if x[0] == "gap"] == [(at, at + len(members[1]))]


def test_any_damage_keeps_the_other_records():
    make = random.Random(5)
    for compress in (bytes, gzip.compress):
        parts = [compress(x) for x in _plain(8)]
        ends = [sum(map(len, parts[: i + 1])) for i in range(8)]
        for _ in range(60):
            hurt = bytearray(b"".join(parts))
            at = make.randrange(len(hurt))
            hurt[at] ^= make.randint(1, 255)
            found = list(salvage(bytes(hurt)))
            broken = next(i for i, e in enumerate(ends) if at < e)
            assert set(_ids_or_none(found)) >= {i for i in range(8) if i != broken}
            gaps = sum(x[2] - x[1] for x in found if x[0] == "gap")
            assert gaps <= len(parts[broken])


def _ids_or_none(found):
    out = []
    for x in found:
        if x[0] == "record":
            said = x[2].get("warc-record-id", "")
            out.append(int(said[10:-1]) if said[10:-1].isdigit() else None)
    return out


def test_gaps_are_rows(spark, tmp_path):
    parts = _plain(3)
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.warc").write_bytes(parts[0] + b"garbage" + parts[1])
    (tmp_path / "x" / "b.warc.gz").write_bytes(gzip.compress(parts[2]))
    rows = read_archives(spark, str(tmp_path / "x"), payloads=True).collect()
    gaps = [r for r in rows if r["kind"] == "gap"]
    assert [(r["offset"], r["gap_end"]) for r in gaps] == [(len(parts[0]), len(parts[0]) + 7)]
    assert sorted(bytes(r["payload"]) for r in rows if r["kind"] == "record") == [b"body 0 ", b"body 1 z", b"body 2 zz"]


def test_records_of_one_member_are_salvaged():
    parts = _plain(50)
    content = b"".join(parts)
    at = sum(map(len, parts[:20])) + 350
    hurt = bytearray(content)
    hurt[at] ^= 0xFF
    data = gzip.compress(bytes(hurt))
    found = list(salvage(data))
    assert _ids(found) == [i for i in range(50) if i != 20]
    assert [x[:3] for x in found if x[0] != "record"] == [("inner_gap", 0, len(data))]
    # Cut off: all that the rest still holds; damaged in the middle: all before it, and what follows as further members.
    zipped = gzip.compress(content)
    found = list(salvage(zipped[: len(zipped) // 2]))
    assert 15 < len(_ids(found)) < 50 and _ids(found) == list(range(len(_ids(found))))
    assert [x[:3] for x in found if x[0] == "gap"] == [("gap", 0, len(zipped) // 2)]
    hurt = bytearray(zipped + gzip.compress(parts[7]))
    hurt[len(zipped) // 2] ^= 0x55
    found = list(salvage(bytes(hurt)))
    assert _ids(found)[-1] == 7 and len(_ids(found)) > 15
    assert [x[:3] for x in found if x[0] == "gap"] == [("gap", 0, len(zipped))]


def test_large_pages_get_files_of_their_own(spark, tmp_path):
    make = random.Random(9)
    text = lambda n: "".join(make.choice("abcdefgh <>") for _ in range(997)) * (n // 997 + 1)
    pairs = [(i, text(5_000_000) + str(i)) for i in range(3)] + [(10 + i, text(300_000) + str(i)) for i in range(12)] + [(100 + i, str(i % 50)) for i in range(200)]
    pairs += [(500, pairs[0][1]), (501, pairs[4][1])]
    path = tmp_path / "a"
    found = archived_pages(_pages(spark, pairs).repartition(1), str(path)).collect()
    assert sorted(map(tuple, found), key=repr) == _expected(pairs)
    by_class = {d.name: [p.stat().st_size for p in d.glob("part-*")] for d in path.iterdir() if d.is_dir()}
    assert set(by_class) == {"revisits", "responses-0", "responses-2", "responses-3"}
    assert len([s for s in by_class["responses-3"] if s]) == 3
    assert sum(max(sizes) > 9_000_000 for sizes in by_class.values()) == 0


def test_marks_without_need_lose_nothing(spark, tmp_path, monkeypatch):
    """All marks set, as with very many revisits: every row is decided by the joins."""
    from threatlog.llm import warc

    monkeypatch.setattr(warc, "with_mark", lambda rows, key, keys, mark: rows.selectExpr("*", f"true as {mark}"))
    pairs = [(i, f"page {i % 30}") for i in range(90)] + [(None, "page 3"), (89, "page 29"), (200, None), (201, "")]
    found = archived_pages(_pages(spark, pairs), str(tmp_path / "a")).collect()
    assert sorted(map(tuple, found), key=repr) == _expected(pairs)
