"""Chunk fingerprints against a plain walk, and likeness of edited and next documents."""

import hashlib
import random

import numpy as np

from tidemark.llm import fingerprints as fp


def plain_chunks(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        stop = min(at + fp.MOST, len(data))
        for p in range(at + fp.LEAST - 1, min(at + fp.MOST, len(data))):
            h = sum(int(fp._GEAR[data[p - i]]) << i for i in range(fp.LEAST)) % (1 << 32)
            bits = fp._STRICT if p + 1 < at + fp.NORMAL else fp._LOOSE
            if h >> (32 - bits) == 0:
                stop = p + 1
                break
        out.append(data[at:stop])
        at = stop
    return out


def texts():
    rng = random.Random(3)
    words = ["der", "the", "é", "tion", "日本", "on", "."]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(400))) for _ in range(30)] + ["", "x", "a" * 3000, "b" * 31, "b" * 32]


def test_chunks_equal_a_plain_walk():
    data = [t.encode() for t in texts()]
    text, digest, size = fp.chunk_sets(data)
    for i, d in enumerate(data):
        want = set(plain_chunks(d))
        assert sorted(size[text == i].tolist()) == sorted(map(len, want))
    once = {bytes(c): None for d in data for c in plain_chunks(d)}
    assert len(set(digest.tolist())) == len(once)


def test_next_likeness(spark, monkeypatch):
    monkeypatch.setattr(fp, "_RANGE", 3000)
    rows = [*enumerate(texts()), (50, texts()[0]), (50, "second"), (None, "none"), (60, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = fp.next_likeness(df).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert len(got) == len(rows)
    by_id = {(r.doc_id, r.n_chars, r.edited_sha256): r for r in got}
    prints = {(r.doc_id, r.n_chars): r.fingerprint for r in got}
    for (i, t), (j, f) in zip(order, [*order[1:], order[0]]):
        half = len(t) // 2
        edited = t[: len(t) - half] + f[:half]
        row = by_id[i, len(t), hashlib.sha256(edited.encode()).hexdigest()]
        for other, near in ((row.edited_fingerprint, row.near_edited), (prints[j, len(f)], row.near_next)):
            own = set(row.fingerprint.split())
            weight = sum(int(c.split(":")[1], 16) for c in own)
            shared = sum(int(c.split(":")[1], 16) for c in own & set(other.split()))
            assert np.isclose(near, shared / weight if weight else float(not other))
        assert {c.split(":")[1] for c in row.fingerprint.split()} == {f"{len(c):x}" for c in plain_chunks(t.encode())}
    assert prints[0, len(rows[0][1])] == prints[50, len(rows[0][1])]


def test_empty_and_single(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert fp.next_likeness(df).collect() == [] and fp.fingerprints(df).collect() == []
    one = spark.createDataFrame([(4, "abcd")], "doc_id long, text string")
    (row,) = fp.next_likeness(one).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and row.near_next == 1.0
    assert fp.fingerprints(one).first().fingerprint == row.fingerprint
