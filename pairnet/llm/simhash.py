"""Operator 8: SimHash near-dedup by bit-sliced comparison.

Fingerprints: a bit of the 64 is set if it is set in over half of the XXH64
hashes (seed 42) of the text's word shingles, repeats included.

Links: two fingerprints within ``radius`` bits agree on all bits of at least
``blocks - radius`` of ``blocks`` bit blocks, so the tables keyed by every
choice of that many blocks bring each linked pair together in some bucket
(exact; the number of blocks grows with the number of fingerprints so that a
bucket stays small). In a bucket the fingerprints are stored as 64 vertical
bit planes, 64 fingerprints to a word; a fingerprint is compared with a word
of 64 at a time by carry-save counters, and words are abandoned once all their
distances exceed the radius. A bucket yields the edges of its own components
only, not all its pairs.

Equal fingerprints are one node from the start. A bucket with more than
``HOT`` fingerprints is cut into slices, and each pair of slices is a bucket
of its own, so no task gets all of a hot bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pairnet.llm.common import atoms, narrow, nested, parts_for, quoted, shuffle_parts, text_batches
from pairnet.llm.components import components
from pairnet.session import checkpoint

SEED = 42
#: A bucket's mean size that makes the number of blocks grow.
BUCKET = 64
HOT = 4096
SLICE = 2048
#: Pairs of a fingerprint and a word compared at a time.
JOBS = 1 << 15

U = np.uint64
ALL = U(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str, size: int = 4) -> int:
    """SimHash of a text's word shingles (A-Z lower-cased, words split at
    ASCII white space); no words: zero. Whole text, a block of shingles at a
    time."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    n = max(1, len(words) - size + 1)
    starts = [0, *ends]
    stops = ends[min(size, len(words)) - 1:]
    one = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, 1 << 15):
        h = np.array([digest(joined[a:b - 1], SEED)
                      for a, b in zip(starts[lo:min(n, lo + (1 << 15))], stops[lo:lo + (1 << 15)])], "<u8")
        one += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * one > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``fp`` (the 64 bits as a signed long) of every row."""
    rows = narrow(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches):
            fp = np.array([fingerprint(t, size) for t in b.column("text").to_pylist()], U).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return rows.mapInArrow(run, "doc_id long, fp long")


# --- comparison -------------------------------------------------------------

def planes(fps: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vertical bit planes of consecutive groups of fingerprints.

    ``first``/``size``: where each group starts and how many it has. Gives
    planes[64, words], the first word of each group, and the word of each
    fingerprint's lane numbers (its position in the padded lanes)."""
    words = -(-size // 64)
    word0 = np.concatenate([[0], np.cumsum(words)])
    lane = np.arange(len(fps)) - np.repeat(first, size) + np.repeat(64 * word0[:-1], size)
    padded = np.zeros(64 * int(word0[-1]), U)
    padded[lane] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    # bits[lane, bit] -> packed over 64 lanes for every bit
    out = np.packbits(bits.reshape(-1, 64, 64).transpose(2, 0, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(out).view("<u8")[:, :, 0], word0, lane


def near_lanes(p: np.ndarray, fps: np.ndarray, word: np.ndarray, lanes: np.ndarray, radius: int):
    """For jobs (a fingerprint against a word of 64 lanes): the indexes of the
    jobs that are left and the lanes, of those in ``lanes``, within ``radius``.

    Counters c0, c1, c2 and a sticky overflow count to seven and beyond by
    carry-save addition, two planes at a time; every eight planes the jobs in
    which all lanes exceed the radius are dropped."""
    job = np.arange(len(fps))
    c0, c1, c2, over = (np.zeros(len(fps), U) for _ in range(4))

    def within():
        low = np.zeros_like(c0)
        for v in range(radius + 1):  # radius is at most 7
            hit = ~over
            for c, bit in ((c0, 1), (c1, 2), (c2, 4)):
                hit &= c if v & bit else ~c
            low |= hit
        return low

    for bit in range(0, 64, 2):
        x = p[bit][word] ^ (U(0) - ((fps >> U(bit)) & U(1)))
        y = p[bit + 1][word] ^ (U(0) - ((fps >> U(bit + 1)) & U(1)))
        carry = (c0 & x) | (y & (c0 ^ x))
        c0 = c0 ^ x ^ y
        up = c1 & carry
        c1 = c1 ^ carry
        over |= c2 & up
        c2 = c2 ^ up
        if bit % 8 == 6:
            live = (within() & lanes) != 0
            if not live.all():
                job, word, fps, lanes = job[live], word[live], fps[live], lanes[live]
                c0, c1, c2, over = c0[live], c1[live], c2[live], over[live]
                if not len(job):
                    break
    return job, within() & lanes


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the classes of ``a`` and ``b`` in ``label`` (smallest member)."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            nxt = label[label]
            if np.array_equal(nxt, label):
                break
            label[:] = nxt


def link_groups(fps: np.ndarray, first: np.ndarray, size: np.ndarray, side: np.ndarray, radius: int) -> np.ndarray:
    """The class of every fingerprint within its group (index of the class's
    first member). ``side``: 0, or 1 for the second slice of a pair of slices;
    only fingerprints of side 0 are compared, with all lanes after them."""
    label = np.arange(len(fps))
    p, word0, lane = planes(fps, first, size)
    group = np.repeat(np.arange(len(size)), size)
    member = np.full(p.shape[1] * 64, -1)
    member[lane] = np.arange(len(fps))
    query = np.flatnonzero(side == 0)
    own = lane[query] // 64
    count = word0[group[query] + 1] - own  # words from its own to the group's last
    last = np.zeros(p.shape[1], U)
    np.bitwise_or.at(last, lane // 64, U(1) << (lane % 64).astype(U))
    total = np.cumsum(count)
    at = 0
    while at < len(query):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + JOBS, "right")))
        n = count[at:end]
        q = np.repeat(np.arange(at, end), n)
        word = own[q] + np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
        lanes = last[word].copy()
        self_word = word == own[q]
        bit = (lane[query[q]] % 64).astype(U)
        lanes[self_word] &= ~(((U(1) << bit[self_word]) << U(1)) - U(1))  # after the query itself
        some = lanes != 0
        q, word, lanes = q[some], word[some], lanes[some]
        job, hit = near_lanes(p, fps[query[q]], word, lanes, radius)
        if len(job):
            bits = np.unpackbits(hit.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            j, b = np.nonzero(bits)
            merge(label, query[q[job[j]]], member[64 * word[job[j]] + b])
        at = end
    return label


# --- candidate tables ---------------------------------------------------------

def blocks_for(n: int, radius: int) -> int:
    """The least number of bit blocks for which a bucket of ``n`` spread-out
    fingerprints has about ``BUCKET`` members at most."""
    blocks = radius + 1
    while blocks < radius + 5 and n / 2 ** (64 * (blocks - radius) // blocks) > BUCKET:
        blocks += 1
    return blocks


def masks(blocks: int, radius: int) -> list[int]:
    """The bits of each table's key: every choice of ``blocks - radius`` blocks."""
    edge = [64 * k // blocks for k in range(blocks + 1)]
    block = [((1 << edge[k + 1]) - 1) ^ ((1 << edge[k]) - 1) for k in range(blocks)]
    return [sum(block[k] for k in c) for c in combinations(range(blocks), blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Edges ``a``, ``b`` between distinct fingerprints (column ``fp``) whose
    components are those of all pairs within ``radius`` bits."""
    if not 0 <= radius <= 7:
        raise ValueError("the counters hold a radius of 0 to 7")
    distinct = checkpoint(fps.select("fp").distinct(), "fps")
    n = distinct.count()
    keys = masks(blocks_for(n, radius), radius)
    table = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
                                for t, m in enumerate(keys)])).alias("k")
    rows = distinct.select("fp", table).select("fp", F.col("k.t").alias("t"), F.col("k.key").alias("key"))
    sizes = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"))
    hot = checkpoint(sizes.where(F.col("n") > HOT), "hot")
    whole = rows.select("fp", "t", "key", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"))
    if not hot.isEmpty():
        # A hot bucket's members go to slices by hash; each pair of slices is one bucket.
        named = rows.join(hot, ["t", "key"])
        cuts = F.ceil(F.col("n") / SLICE).cast("int")
        own = F.pmod(F.xxhash64("fp", "t"), cuts).cast("int")
        sliced = named.select("fp", "t", "key", own.alias("s"), F.explode(F.sequence(F.lit(0), cuts - 1)).alias("o"))
        sliced = sliced.select("fp", "t", "key", F.least("s", "o").alias("i"), F.greatest("s", "o").alias("j"),
                               F.when(F.col("s") <= F.col("o"), 0).otherwise(1).alias("side"))
        whole = whole.join(hot.select("t", "key"), ["t", "key"], "left_anti").unionByName(sliced)
    parts = max(shuffle_parts(fps), parts_for(n * len(keys), 400_000))
    dealt = whole.repartition(parts, "t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j", "side", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:  # groups of the partition in order; the last one may go on
            held.append(b)
            if sum(x.num_rows for x in held) >= 1 << 16:
                held = yield from link(pa.Table.from_batches(held), False)
        if held:
            yield from link(pa.Table.from_batches(held), True)

    def link(rows: pa.Table, last: bool):
        key = [rows.column(c).to_numpy() for c in ("t", "key", "i", "j")]
        turn = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
        first = np.concatenate([[0], turn]).astype(np.int64)
        stop = len(key[0]) if last else int(first[-1])
        rest = [] if last else rows.slice(stop).combine_chunks().to_batches()
        first = first[first < stop]
        if stop:
            size = np.diff(np.append(first, stop))
            fp = rows.column("fp").to_numpy()[:stop]
            some = np.repeat(size > 1, size)
            if some.any():
                size = size[size > 1]
                own = fp[some]
                label = link_groups(np.ascontiguousarray(own).view(U), np.cumsum(size) - size, size,
                                    rows.column("side").to_numpy()[:stop][some], radius)
                child = np.flatnonzero(label != np.arange(len(label)))
                yield pa.RecordBatch.from_arrays([pa.array(own[child]), pa.array(own[label[child]])], ["a", "b"])
        return rest

    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_groups(docs: DataFrame, size: int = 4, radius: int = 4, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hexadecimal digits), ``component_id``
    (the smallest ``doc_id`` reachable over links) and ``component`` (the
    fingerprint that names the component, also where ids are null or shared) of
    every row.

    Null and empty texts have the fingerprint zero and link like others.
    Repeated rows are in one component. A null id stays null and never names
    a component that has another id. Other columns are ignored; an empty table
    gives an empty result."""
    fps = checkpoint(fingerprints(docs, size, id_col, text_col), "fingerprints")
    node = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    root = components(links(fps, radius))
    # Every fingerprint's component: its root, or itself.
    named = node.join(root.select(F.col("node").alias("fp"), "root"), "fp", "left") \
        .select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = checkpoint(named, "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(least, "root").select("fp", "component_id", _hex("root").alias("component"))
    return fps.join(by_fp, "fp").select("doc_id", _hex("fp").alias("fingerprint"), "component_id", "component")


def _hex(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def representatives(docs: DataFrame, groups: DataFrame, size: int = 4, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for every component in ``groups`` (of the same
    ``size``): the one with the component's smallest id (of several, or in a
    component without any id, the first by all columns that can be ordered).

    A row is known by its id and its fingerprint together, as rows of several
    components may share an id or have none."""
    stay = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))) \
        .select(F.col("doc_id").alias("stay"), "fingerprint", "component").distinct()
    own = nested(docs, own=quoted(id_col).cast("long"), text=quoted(text_col).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [f"{fingerprint(t or '', size):016x}" for part in text_batches([b.select(["text"])])
                   for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("own"), pa.array(fps, pa.string())],
                                             ["doc", "own", "fp"])

    schema = StructType([own.schema["doc"], own.schema["own"], StructField("fp", StringType())])
    joined = own.mapInArrow(run, schema).join(
        stay, F.col("own").eqNullSafe(F.col("stay")) & (F.col("fp") == F.col("fingerprint")))
    nth = F.row_number().over(Window.partitionBy("component").orderBy(*atoms(docs)))
    return joined.withColumn("nth", nth).where("nth = 1").select("doc.*")
