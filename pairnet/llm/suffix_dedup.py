"""Operator 1: suffix-array dedup by threshold-bounded interval expansion.

A byte is removed if it lies in a ``length``-byte string that also starts in a
document with a smaller id. Equal strings are found on a Burrows-Wheeler
transform: breadth-first backward extension takes the intervals of strings of
one length to those of strings one byte longer, so common prefixes come out by
increasing value, and stops at ``length``; what then shares an interval shares
that many bytes.

To do that in many bounded transforms, every ``length``-byte string is dealt
by its anchor, the ``KMER``-byte substring with the least hash: equal strings
have equal anchors, and a run of strings around one anchor travels as one
short text. A document whose whole text also stands under a smaller id goes at once (equal
texts, by digest). Rounds over hashed blocks of the others:

1. A block's distinct anchor fingerprints go to buckets, which answer which of
   them occur under two or more ids anywhere (one bit each, no false
   negatives).
2. The runs around shared anchors, once a block for equal runs, go to shards.
   A shard builds the transform of its distinct runs and answers for each
   string whether it starts under a smaller id. Strings around an anchor with
   more than ``HOT`` runs are dealt one by one by their own hash instead.
3. The block marks the covered bytes and cuts them out.

All rounds are one plan; the shuffle that deals texts into blocks is reused.
Groups never hold more than a block, a bucket or a shard; copies of a passage
are folded within each block before they travel.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairnet.llm.common import input_bytes, narrow, parts_for, shuffle_parts
from pairnet.session import checkpoint

KMER = 24
BLOCK_BYTES = 4 << 20
PART_BYTES = 16 << 20
BUCKET_ANCHORS = 2_000_000
#: Text bytes of the input per shard, and bytes a transform takes at most (a
#: larger shard is done in several).
SHARD_BYTES = 4 << 20
TRANSFORM_BYTES = 1 << 18
HOT = 20_000
SEGMENT = 1 << 19

U = np.uint64
NO_ID = -(1 << 63)


# --- anchors ----------------------------------------------------------------

def _byte_values() -> np.ndarray:
    return np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)


_VALUES = _byte_values()


def _mix(h: np.ndarray, by: int) -> np.ndarray:
    h = (h ^ (h >> U(29))) * U(by)
    return h ^ (h >> U(32))


def kmer_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every ``size``-byte substring, by doubling (any size)."""
    base = 0x9E3779B97F4A7C15
    have, at, power = None, 0, 1  # hash of the last `at` symbols so far
    block, width = _VALUES[data], 1
    while True:
        if size & width:
            n = len(data) - at - width + 1
            have = block[:n].copy() if have is None else have[:n] * U(pow(base, width, 1 << 64)) + block[at:at + n]
            at += width
        if width * 2 > size:
            break
        n = len(block) - width
        block = block[:n] * U(pow(base, width, 1 << 64)) + block[width:width + n]
        width *= 2
    return _mix(have, 0xFF51AFD7ED558CCD)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n, have = len(x) - width + 1, 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[width - have:width - have + n])


def runs(data: np.ndarray, ends: np.ndarray, length: int, kmer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts that share an anchor: first start, number of
    starts, and the anchor's 64-bit fingerprint.

    ``data``: a block's documents one after the other, ``ends`` their ends. A
    window lies in one document. The anchor is the leftmost of the least 40
    bits of hash among the window's k-mers, which depends on the window alone."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    width, total = length - kmer + 1, len(data)
    for s in range(0, max(0, total - length + 1), SEGMENT):
        e = min(s + SEGMENT, total - length + 1)
        h = kmer_hashes(data[s:e + length - 1], kmer)
        packed = (h >> U(24) << U(24)) | np.arange(len(h), dtype=np.uint64)
        anchor = (sliding_min(packed, width) & U((1 << 24) - 1)).astype(np.int64)
        inside = np.ones(e - s, bool)  # a window that would leave its document starts nowhere
        for end in ends[np.searchsorted(ends, s, "right"):np.searchsorted(ends, e + length, "right")].tolist():
            inside[max(0, end - length + 1 - s):max(0, end - s)] = False
        good = np.flatnonzero(inside)
        if not len(good):
            continue
        own = anchor[good]
        turn = np.flatnonzero((own[1:] != own[:-1]) | (good[1:] != good[:-1] + 1)) + 1
        first = np.concatenate([[0], turn])
        out.append((good[first] + s, np.diff(np.append(first, len(good))), _mix(h[own[first]], 0xC4CEB9FE1A85EC53)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    return tuple(np.concatenate(x) for x in zip(*out))


# --- the transform ------------------------------------------------------------

def bounded_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by at least ``depth`` symbols (prefix doubling; ties in
    any order), and each suffix's row. ``text``: symbols 0 to 256."""
    n, have = len(text), 7
    key = np.zeros(n, np.int64)
    for k in range(7):
        key <<= 9
        key[:n - k] |= text[k:]
    order = np.argsort(key)
    rank = np.empty(n, np.int64)

    def ranked() -> None:
        sorted_ = key[order]
        rank[order] = np.cumsum(np.concatenate([[False], sorted_[1:] != sorted_[:-1]]))

    ranked()
    while have < depth:
        key = rank << 32
        key[:n - have] |= rank[have:] + 1
        # Only suffixes that still share their rank move.
        own = rank[order]
        same = own[1:] == own[:-1]
        loose = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
        if not len(loose):
            break
        moved = order[loose]
        order[loose] = moved[np.argsort(key[moved])]
        ranked()
        have *= 2
    row = np.empty(n, np.int32)
    row[order] = np.arange(n, dtype=np.int32)
    return order, row


def shared_intervals(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and, per row, whether it opens an interval: rows of one
    interval share their first ``length`` symbols.

    Backward extension, all intervals of a level at once: prepending a row's
    transform symbol takes it to the row of the longer suffix, so two
    neighbouring rows stay together at the next length if they begin with the
    same symbol and the rows they extend are together at this one. Rows that
    part at a level have just that common prefix; they are dropped from the
    queue, which ends at ``length`` or when it is empty."""
    n = len(text)
    order, row = bounded_order(text, length)
    source = row[(order + 1) % n]  # the row that a row extends
    place = np.arange(n, dtype=np.int32)
    opens = np.zeros(n, bool)
    opens[0] = True
    head = text[order]
    queue = place[1:]
    queue = queue[head[queue] == head[queue - 1]]
    opens[1:] = True
    opens[queue] = False
    for _ in range(1, length):
        if not len(queue):
            break
        interval = np.cumsum(opens, dtype=np.int32)
        apart = interval[source[queue]] != interval[source[queue - 1]]
        opens[queue[apart]] = True
        queue = queue[~apart]
    return order, opens


def least_ids(contents: list[bytes], ids: np.ndarray, length: int) -> list[np.ndarray]:
    """For every content and every ``length``-byte string in it, the least of
    the ids under which that string occurs in any of the contents."""
    joined = b"\0".join(contents) + b"\0"
    text = np.frombuffer(joined, np.uint8).astype(np.int64) + 1
    sizes = np.array([len(c) for c in contents], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    text[starts + sizes] = 0
    order, opens = shared_intervals(text, length)
    owner = np.repeat(np.arange(len(contents)), sizes + 1)
    first = np.flatnonzero(opens)
    least = np.minimum.reduceat(ids[owner[order]], first)
    at = np.empty(len(text), np.int64)
    at[order] = least[np.cumsum(opens) - 1]
    return [at[s:s + n - length + 1] for s, n in zip(starts, sizes)]


# --- a block's side -------------------------------------------------------------

class Block:
    """One block's documents (ordered by id, then text) and its runs."""

    def __init__(self, rows: pa.Table, copies: pa.Table, length: int, kmer: int, buckets: int):
        rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.texts = rows.column("text").to_pylist()
        self.null = np.array([x is None for x in rows.column("doc_id").to_pylist()], bool)
        self.ids = rows.column("doc_id").fill_null(NO_ID).to_numpy().astype(np.int64)
        known = set(zip(copies.column("bucket").to_pylist(), copies.column("data").to_pylist()))
        named = {i for i, _ in known}
        self.copy = np.array([i in named and (i, hashlib.sha256(t).digest()) in known
                              for i, t in zip(self.ids.tolist(), self.texts)], bool)
        live = [b"" if c else t for c, t in zip(self.copy, self.texts)]
        self.raw = b"".join(live)
        self.data = np.frombuffer(self.raw, np.uint8)
        self.sizes = np.array([len(t) for t in live], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.length = length
        filled = self.ends[self.sizes > 0]
        self.first, self.count, self.full = runs(self.data, filled, length, kmer)
        self.doc = np.searchsorted(self.ends, self.first, "right")
        self.bucket = ((self.full >> U(32)) % U(buckets)).astype(np.int64)
        self.mark = (self.full & U(0xFFFFFFFF)).astype(np.uint32)

    def anchors(self):
        """Per bucket: the distinct fingerprints, where they are, under how
        many runs, and whether under several ids. Sorted by bucket and mark."""
        order = np.lexsort((self.mark, self.bucket))
        b, m = self.bucket[order], self.mark[order]
        new = np.concatenate([[True], (b[1:] != b[:-1]) | (m[1:] != m[:-1])]) if len(b) else np.zeros(0, bool)
        which = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        ids = self.ids[self.doc[order]]
        n = np.diff(np.append(first, len(b)))
        several = np.zeros(len(first), bool)
        if len(first):
            several = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)
        cuts = np.flatnonzero(np.concatenate([[True], b[first][1:] != b[first][:-1]])) if len(first) else first
        place = np.empty(len(b), np.int64)
        place[order] = which  # of each run, its fingerprint's number
        return b[first], m[first], n, several, cuts, place

    def candidates(self, answers: pa.Table) -> Candidates:
        """The block's strings for the shards, from the buckets' answers."""
        b, _, _, _, cuts, place = self.anchors()
        state = np.zeros(len(b), np.uint8)
        begin = {int(b[c]): int(c) for c in cuts}
        for bucket, packed, n in zip(answers.column("bucket").to_pylist(), answers.column("data").to_pylist(),
                                     answers.column("n").to_pylist()):
            bits = np.unpackbits(np.frombuffer(packed, np.uint8), count=2 * n)
            state[begin[bucket]:begin[bucket] + n] = bits[:n] + bits[n:]
        own = state[place] if len(place) else np.zeros(0, np.uint8)
        shared, hot = np.flatnonzero(own == 1), np.flatnonzero(own == 2)
        # The strings around a hot anchor stand alone.
        single, several = expand(self.first[hot], self.count[hot]), np.repeat(hot, self.count[hot])
        lo = np.concatenate([self.first[shared], single])
        n = np.concatenate([self.count[shared], np.ones(len(single), np.int64)])
        doc = self.ids[self.doc[np.concatenate([shared, several])]]
        order = np.argsort(doc, kind="stable")  # the first of equal contents has the least id
        lo, n, doc = lo[order], n[order], doc[order]
        raw, entry = self.raw, {}
        which = np.array([entry.setdefault(raw[a:z], len(entry))
                          for a, z in zip(lo.tolist(), (lo + n + self.length - 1).tolist())], np.int64)
        _, head = np.unique(which, return_index=True)
        key = np.concatenate([self.full[shared], np.zeros(len(single), U)])[order][head]
        alone = np.flatnonzero((order >= len(shared))[head])
        contents = list(entry)
        for k in alone.tolist():
            key[k] = int.from_bytes(hashlib.blake2b(contents[k], digest_size=8).digest(), "little")
        return Candidates(lo, n, doc, which, contents, doc[head], key)

    def covered(self, answers: pa.Table, flags: pa.Table, shards: int) -> np.ndarray:
        """Whether each byte of the block is removed."""
        c = self.candidates(answers)
        size = np.array([len(x) for x in c.contents], np.int64) - self.length + 1
        got = {s: x for s, x in zip(flags.column("bucket").to_pylist(), flags.column("data").to_pylist())}
        begin, bits, at = np.zeros(len(size), np.int64), [], 0
        for shard, members in c.dealt(shards):
            total = int(size[members].sum())
            bits.append(np.unpackbits(np.frombuffer(got[shard], np.uint8), count=total))
            begin[members] = at + np.cumsum(size[members]) - size[members]
            at += total
        hit = np.zeros(len(self.data) + 1, np.int8)
        if len(c.lo):
            answer = np.concatenate(bits)[expand(begin[c.which], c.n)]
            hit[expand(c.lo, c.n)] = answer | np.repeat(c.doc > c.least[c.which], c.n)
        seen = np.concatenate([np.zeros(self.length, np.int32), np.cumsum(hit[:-1], dtype=np.int32)])
        return seen[self.length:] > seen[:-self.length]


def expand(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each of the counts, one after the other."""
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)


class Candidates(NamedTuple):
    """Runs (or single strings of hot anchors): first window start, number of
    starts, id, content; per distinct content its least id and shard key."""

    lo: np.ndarray
    n: np.ndarray
    doc: np.ndarray
    which: np.ndarray
    contents: list[bytes]
    least: np.ndarray
    key: np.ndarray

    def dealt(self, shards: int):
        """(shard, its contents' numbers), both in ascending order."""
        shard = ((self.key >> U(20)) % U(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        cut = np.flatnonzero(np.diff(shard[order])) + 1
        return [(int(shard[x[0]]), x) for x in np.split(order, cut) if len(x)]


def answer_bucket(rows: pa.Table) -> pa.Table:
    """For each block's fingerprints of one bucket two bits: whether the
    fingerprint occurs under several ids, and whether its runs are hot."""
    marks = [np.frombuffer(x, "<u4") for x in rows.column("marks").to_pylist()]
    several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(m))
               for x, m in zip(rows.column("several").to_pylist(), marks)]
    n = [np.frombuffer(x, "<u4") for x in rows.column("counts").to_pylist()]
    every, back = np.unique(np.concatenate(marks), return_inverse=True)
    blocks = np.bincount(back, minlength=len(every))
    total = np.bincount(back, np.concatenate(n), minlength=len(every))
    shared = (blocks > 1) | (np.bincount(back, np.concatenate(several), minlength=len(every)) > 0)
    hot = shared & (total > HOT)
    out, at = [], 0
    for m in marks:
        own = back[at:at + len(m)]
        at += len(m)
        out.append(np.packbits(np.concatenate([shared[own], hot[own]])).tobytes())
    return pa.table({"block": rows.column("block"), "bucket": rows.column("bucket"), "kind": pa.array([0] * len(out), pa.int32()),
                     "n": pa.array([len(m) for m in marks], pa.int32()), "data": pa.array(out, pa.binary())})


def answer_shard(rows: pa.Table, length: int) -> pa.Table:
    """For each block's entries of one shard a bit per string: whether it
    starts under a smaller id than the entry's."""
    own_ids = [np.frombuffer(x, "<i8") for x in rows.column("ids").to_pylist()]
    sizes = [np.frombuffer(x, "<u4") for x in rows.column("sizes").to_pylist()]
    subs = [np.frombuffer(x, "<u2") for x in rows.column("subs").to_pylist()]
    number: dict[bytes, int] = {}
    contents: list[bytes] = []
    sub: list[int] = []
    least: list[int] = []
    places: list[list[int]] = []
    for data, size, ids, ss in zip(rows.column("data").to_pylist(), sizes, own_ids, subs):
        at, mine = 0, []
        for n, doc, s in zip(size.tolist(), ids.tolist(), ss.tolist()):
            content = data[at:at + n]
            at += n
            k = number.get(content)
            if k is None:
                k = number[content] = len(contents)
                contents.append(content)
                least.append(doc)
                sub.append(s)
            elif doc < least[k]:
                least[k] = doc
            mine.append(k)
        places.append(mine)
    ids = np.array(least, np.int64)
    found: list[np.ndarray | None] = [None] * len(contents)
    # Equal strings have equal sub keys, so a large shard is done in portions.
    order = sorted(range(len(contents)), key=sub.__getitem__)
    portion: list[int] = []
    held = 0
    for i, k in enumerate(order):
        portion.append(k)
        held += len(contents[k]) + 1
        if i + 1 == len(order) or held >= TRANSFORM_BYTES and sub[order[i + 1]] != sub[k]:
            for p, x in zip(portion, least_ids([contents[p] for p in portion], ids[portion], length)):
                found[p] = x
            portion, held = [], 0
    out = [np.packbits(np.concatenate([found[k] < doc for k, doc in zip(mine, docs.tolist())])).tobytes()
           for mine, docs in zip(places, own_ids)]
    return pa.table({"block": rows.column("block"), "bucket": rows.column("shard"), "kind": pa.array([1] * len(out), pa.int32()),
                     "n": pa.array([len(m) for m in places], pa.int32()), "data": pa.array(out, pa.binary())})


# --- the operator -----------------------------------------------------------------

#: kind 0: a bucket's answer, 1: a shard's, 2: a whole copy (id and digest).
ANSWER = "block long, bucket long, kind int, n int, data binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>"


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text",
                   with_text: bool = False) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_bytes``, ``n_removed``,
    ``n_spans``, ``kept_sha256``, ``spans`` (maximal removed byte ranges) and,
    on request, the ``kept`` bytes.

    Strings are judged on the input. A null text is empty. Rows that share an
    id are one document to each other: nothing is removed between them; a null
    id is smaller than any other. Rows with one id are dealt into blocks by
    their texts, so only rows equal in both come together. Texts shorter than ``length`` stay whole.
    Other columns are ignored; an empty table gives an empty result."""
    if length < 4:
        raise ValueError("length of at least 4")
    kmer = max(1, min(KMER, length - 1))
    rows = narrow(docs, id_col, text_col)
    n, size = input_bytes(rows)
    blocks, buckets = parts_for(size + n, BLOCK_BYTES), parts_for(size, 10 * BUCKET_ANCHORS)
    shards, parts = parts_for(size, SHARD_BYTES), max(shuffle_parts(docs), parts_for(size + n, PART_BYTES))
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    own_id = F.coalesce("doc_id", F.lit(NO_ID))
    # By text too: one id, or none, may have a third of all rows.
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))
    dealt = rows.select("doc_id", text.alias("text"), block.alias("block")).repartition(parts, "block")
    # Whole copies: long enough, and under a larger id than the first of them.
    digests = rows.where(F.octet_length("text") >= length).select(
        block.alias("block"), own_id.alias("id"), F.unhex(F.sha2(F.col("text"), 256)).alias("digest"))
    # Written first, so that the join can split a digest with many of the rows.
    first = digests.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most")) \
        .where("least < most").select(F.col("digest").alias("d"), "least")
    first = checkpoint(first, "first-copies")
    copies = digests.join(first, (F.col("digest") == F.col("d")) & (F.col("id") > F.col("least"))).distinct().select(
        "block", F.col("id").alias("bucket"), F.lit(2).alias("kind"), F.lit(1).alias("n"),
        F.col("digest").alias("data"))

    def only(t: pa.Table, kind: int) -> pa.Table:
        return t.filter(pa.array(t.column("kind").to_numpy() == kind))

    def collect(t: pa.Table, more: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if t.num_rows:
            b, m, count, several, cuts, _ = Block(t, only(more, 2), length, kmer, buckets).anchors()
            out = [(int(b[x]), m[x:y].tobytes(), np.minimum(count[x:y], 1 << 31).astype("<u4").tobytes(),
                    np.packbits(several[x:y]).tobytes()) for x, y in zip(cuts, np.append(cuts[1:], len(b)))]
        cols = list(zip(*out)) or [[], [], [], []]
        block = t.column("block")[0].as_py() if t.num_rows else 0
        return pa.table({"bucket": pa.array(cols[0], pa.int64()), "block": pa.array([block] * len(out), pa.int64()),
                         "marks": pa.array(cols[1], pa.binary()), "counts": pa.array(cols[2], pa.binary()),
                         "several": pa.array(cols[3], pa.binary())})

    def send(t: pa.Table, more: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if t.num_rows:
            c = Block(t, only(more, 2), length, kmer, buckets).candidates(only(more, 0))
            size = np.array([len(x) for x in c.contents], "<u4")
            for shard, members in c.dealt(shards):
                out.append((shard, size[members].tobytes(), c.least[members].astype("<i8").tobytes(),
                            (c.key[members] & U(0xFFFF)).astype("<u2").tobytes(),
                            b"".join([c.contents[k] for k in members.tolist()])))
        cols = list(zip(*out)) or [[]] * 5
        block = t.column("block")[0].as_py() if t.num_rows else 0
        return pa.table({"shard": pa.array(cols[0], pa.int64()), "block": pa.array([block] * len(out), pa.int64()),
                         **{name: pa.array(c, pa.binary()) for name, c in zip(("sizes", "ids", "subs", "data"), cols[1:])}})

    def finish(t: pa.Table, more: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if t.num_rows:
            own = Block(t, only(more, 2), length, kmer, buckets)
            gone = own.covered(only(more, 0), only(more, 1), shards)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
            cut = np.union1d(edge, own.ends)  # removed runs end with their document
            for k, text_ in enumerate(own.texts):
                lo, hi = int(own.ends[k] - own.sizes[k]), int(own.ends[k])
                mark = [lo, *cut[np.searchsorted(cut, lo, "right"):np.searchsorted(cut, hi, "left")].tolist(), hi]
                pairs = [(a - lo, z - lo) for a, z in zip(mark, mark[1:]) if z > a and gone[a]]
                if own.copy[k]:
                    pairs = [(0, len(text_))]
                stay, at = [], 0
                for a, z in pairs:
                    stay.append(text_[at:a])
                    at = z
                kept = b"".join([*stay, text_[at:]])
                out.append((None if own.null[k] else int(own.ids[k]), len(text_), len(text_) - len(kept), len(pairs),
                            hashlib.sha256(kept).hexdigest(), [{"start": a, "end": z} for a, z in pairs], kept))
        cols = list(zip(*out)) or [[]] * 7
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.binary()]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"][:6 + with_text]
        return pa.table({c: pa.array(x, k) for c, x, k in zip(names, cols, kinds)})

    def beside(more: DataFrame):
        return dealt.groupBy("block").cogroup(more.groupBy("block"))

    marks = beside(copies).applyInArrow(
        collect, "bucket long, block long, marks binary, counts binary, several binary")
    answers = copies.unionByName(marks.groupBy("bucket").applyInArrow(answer_bucket, ANSWER))
    sent = beside(answers).applyInArrow(
        send, "shard long, block long, sizes binary, ids binary, subs binary, data binary")
    flags = sent.groupBy("shard").applyInArrow(lambda t: answer_shard(t, length), ANSWER)
    return beside(answers.unionByName(flags)).applyInArrow(finish, RESULT + ", kept binary" * with_text)
