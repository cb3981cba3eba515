"""Operator 12 against best fit by a plain search, and whole round trips."""

import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from pairnet.llm import window_packing
from pairnet.llm.encoders import Encoder
from pairnet.llm.window_packing import best_fit_decreasing, pack, packed_windows, padded
from test_llm import BPE, edge, small


def plain_best_fit(lengths, capacity):
    rooms, out = [], []
    for n in lengths:
        fits = [(r, k) for k, r in enumerate(rooms) if r >= n]
        k = min(fits)[1] if fits else len(rooms)
        if not fits:
            rooms.append(capacity)
        rooms[k] -= n
        out.append(k)
    return rooms, out


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(2)
    for capacity in (1, 7, 64, 100, 1024):
        for _ in range(25):
            lengths = sorted((rng.randint(1, capacity) for _ in range(rng.randrange(120))), reverse=True)
            rooms = Counter()
            for n, k in zip(lengths, best_fit_decreasing(lengths, capacity)):
                rooms[k] += n
            # Windows with equal room may be taken in any order; their fills are the same.
            assert sorted(rooms.values()) == sorted(capacity - r for r in plain_best_fit(lengths, capacity)[0])


def whole(docs, rows, capacity):
    """Every id lies in exactly one piece; sequences are gapless."""
    enc = Encoder(BPE)
    texts = [(r["doc_id"], enc.encode([r["text"] or ""])[0] + b"\0\0\0\0") for r in docs.collect()]
    known = Counter()
    for doc_id, ids in texts:
        n = len(ids) // 4
        for at in range(0, n, capacity):
            own = ids[4 * at:4 * (at + capacity)]
            known[doc_id, at, len(own) // 4, zlib.crc32(own), n] += 1
    assert known == Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows)
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity
    return len(places), sum(n for own in places.values() for _, n in own)


def test_documents_round_trip(spark, monkeypatch):
    monkeypatch.setattr(window_packing, "GROUP_PIECES", 40)  # several groups and levels
    docs = small(spark)
    got = packed_windows(docs, BPE, 512)
    rows = got.collect()
    n, total = whole(docs, rows, 512)
    rest = sorted((r["length"] for r in rows if r["length"] < 512), reverse=True)
    plain = len(plain_best_fit(rest, 512)[0]) + sum(r["length"] == 512 for r in rows)
    assert n <= 1.01 * plain + 1
    kept = padded(got, 512).collect()
    assert sum(r["length"] for r in kept) == total
    assert all(r["padding"] == (0 if r["length"] & (r["length"] - 1) == 0 else 512 - r["length"]) for r in kept)


def test_edges(spark):
    docs = edge(spark)
    rows = packed_windows(docs, BPE, 64, with_ids=True).collect()
    whole(docs, rows, 64)
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in rows)
    assert packed_windows(docs.limit(0), BPE).count() == 0


def test_pieces_that_fit_badly_stand(spark, monkeypatch):
    """No two fit one window, so packing them again could go on for ever."""
    monkeypatch.setattr(window_packing, "GROUP_PIECES", 10)
    pieces = spark.range(100).select("id", F.lit(600).cast("long").alias("length"), F.lit("x").alias("offset"))
    rows = pack(pieces, 1024).collect()
    assert len({r["sequence_id"] for r in rows}) == 100 and all(r["offset"] == 0 for r in rows)
    assert sorted(r["id"] for r in rows) == list(range(100))
