"""Operator 2: best-fit packing by a grouping genetic algorithm.

An individual is a partition of documents' pieces into bins (sequences).
Crossover injects whole well-filled bins of one parent into the other, takes
out the bins that hold any injected piece twice, and puts the displaced pieces
back by best fit, longest first. Mutation dissolves the emptiest bins, lets
the others swap one or two pieces for loose ones that fill them better, and
best-fits what is loose then.

Pieces are dealt by hash into groups of bounded size. Every group is bred on
several islands (a row each, spread over the cluster); between epochs the
elite of an island moves to the next one of its group. The best individual of
a group's islands wins. The emptiest bins with room that a group leaves (an
eighth of its bins, up to half if they are poorly filled) are dissolved and
their pieces form the groups of the next level, until one group is left, so
unused room doesn't grow with the number of groups. A group whose other bins
are full, but for a few tokens, needs no breeding: what it leaves open is packed
anew anyway, and breeding hardly fills what stands any better.
"""

from __future__ import annotations

import random
import struct
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairnet.llm.common import narrow, parts_for, release, shuffle_parts, text_batches
from pairnet.llm.encoders import encoder
from pairnet.session import checkpoint

#: Bytes of text encoded at a time.
SLICE = 4 << 20
GROUP_PIECES = 2048
#: Full sequences that a group's pieces fill at least, on average.
GROUP_BINS = 64
ISLANDS = 3
EPOCHS = 2
POPULATION = 6
GENERATIONS = 6
#: Of the last level, which is one group: its leftovers are all that is lost.
LAST_GENERATIONS = 40
#: Share of a group's bins that are dissolved for the next level, and the
#: share up to which those filled below ``POOR`` are too.
OPEN, OPEN_POOR = 1 / 8, 1 / 2
POOR = 0.9
#: Share of a group's tokens up to which the room in the bins that stand is left there.
SETTLED = 1 / 4096
#: Bins of up to so many pieces also swap two pieces at a time.
WIDE = 8
#: Up to so many displaced pieces are offered to the bins for swaps.
LOOSE = 64

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def cut(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0,
        id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every row's token ids (and ``end_id``) cut into pieces of at most
    ``capacity``; only the first piece of a longer document may be shorter.
    A null text counts as empty: one piece with ``end_id`` alone."""
    rows = narrow(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for b in text_batches(batches, SLICE, 20_000):
            out: list[tuple] = []
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text"))):
                ids += end
                n = len(ids) // 4
                first = n if n <= capacity else n % capacity or capacity
                at = [0, *range(first, n + 1, capacity)]
                for k, (lo, hi) in enumerate(zip(at, at[1:])):
                    own = ids[4 * lo:4 * hi]
                    out.append((doc_id, k, lo, hi - lo, zlib.crc32(own), own if with_ids else None))
            cols = list(zip(*out))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             [x.split()[0] for x in PIECES.split(", ")])
        enc.forget()
        release()

    out = rows.mapInArrow(run, PIECES)
    return out if with_ids else out.drop("ids")


class Room:
    """Bins by free room, for best fit in a few operations a piece."""

    def __init__(self, capacity: int):
        self.capacity, self.bins, self.free = capacity, [], []
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def open(self, pieces: list[int], free: int) -> None:
        self.by_free[free].append(len(self.bins))
        self.mask |= 1 << free
        self.bins.append(pieces)
        self.free.append(free)

    def put(self, piece: int, length: int) -> None:
        """Into the bin with the least room that suffices, else a new one."""
        fits = self.mask >> length
        if not fits:
            self.open([piece], self.capacity - length)
            return
        f = length + (fits & -fits).bit_length() - 1
        k = self.by_free[f].pop()
        if not self.by_free[f]:
            self.mask ^= 1 << f
        self.bins[k].append(piece)
        f -= length
        self.by_free[f].append(k)
        self.mask |= 1 << f


def _score(bins: list[list[int]], lengths: list[int]) -> tuple[int, int]:
    return len(bins), -sum(sum(lengths[i] for i in b) ** 2 for b in bins)


def best_fit(order, lengths: list[int], capacity: int, kept: list[list[int]] = ()) -> list[list[int]]:
    room = Room(capacity)
    for b in kept:
        room.open(list(b), capacity - sum(lengths[i] for i in b))
    for i in order:
        room.put(i, lengths[i])
    return room.bins


def crossover(one, two, lengths, capacity, rng) -> list[list[int]]:
    """``one`` with about half of the better-filled bins of ``two`` injected."""
    filled = sorted(two, key=lambda b: -sum(lengths[i] for i in b))
    good = filled[:max(1, len(filled) // 2)]
    injected = [b for b in good if rng.random() < 0.5] or good[:1]
    own = {i for b in injected for i in b}
    kept = [b for b in one if own.isdisjoint(b)]
    displaced = [i for b in one if not own.isdisjoint(b) for i in b if i not in own]
    if len(displaced) <= LOOSE:
        kept = [list(b) for b in kept]
        displaced = swapped(kept, displaced, lengths, capacity)
    displaced.sort(key=lambda i: -lengths[i])
    return best_fit(displaced, lengths, capacity, kept + injected)


def mutate(bins, lengths, capacity, rng) -> list[list[int]]:
    ranked = sorted(bins, key=lambda b: sum(lengths[i] for i in b))
    n = min(len(ranked), 1 + rng.randrange(4))
    away = ranked[:n] + rng.sample(ranked, min(len(ranked), 1 << rng.randrange(5)))
    gone = {id(b) for b in away}
    kept = [list(b) for b in ranked if id(b) not in gone]
    rng.shuffle(kept)
    loose = swapped(kept, {i for b in away for i in b}, lengths, capacity)
    loose.sort(key=lambda i: -lengths[i] * (0.8 + 0.4 * rng.random()))
    return best_fit(loose, lengths, capacity, kept)


def swapped(bins: list[list[int]], loose, lengths: list[int], capacity: int) -> list[int]:
    """Every bin with room gives up one or two pieces for one or two ``loose``
    ones that fill it better, as far as there are any; returns what is loose
    after that. Loose pieces only get shorter, so they are easier to place."""
    order = sorted((lengths[i], i) for i in loose)
    for b in bins:
        free = capacity - sum(lengths[i] for i in b)
        if not free or not order:
            continue
        best, gain = None, 0
        for out in [*((i,) for i in b), *(combinations(b, 2) if len(b) <= WIDE else ())]:
            own = sum(lengths[i] for i in out)
            top = own + free
            one = bisect_right(order, (top, len(lengths))) - 1
            if one >= 0 and order[one][0] - own > gain:
                best, gain = (out, (order[one],)), order[one][0] - own
            lo, hi = 0, len(order) - 1
            while lo < hi and gain < free:
                both = order[lo][0] + order[hi][0]
                if both > top:
                    hi -= 1
                    continue
                if both - own > gain:
                    best, gain = (out, (order[lo], order[hi])), both - own
                lo += 1
            if gain == free:
                break
        if best:
            out, into = best
            b[:] = [i for i in b if i not in out] + [i for _, i in into]
            for x in into:
                order.remove(x)
            for i in out:
                insort(order, (lengths[i], i))
    return [i for _, i in order]


def evolve(lengths: list[int], population: list[list[list[int]]], capacity: int, seed: str,
           size: int = POPULATION, generations: int = GENERATIONS, spare: float = 0.0) -> list[list[list[int]]]:
    """The population after some generations, best first; ends at once when
    the best one uses no more bins than the total length needs, or has hardly
    any room (``SETTLED``) but in the share ``spare`` of its bins, the emptiest
    ones (these are packed anew)."""
    rng = random.Random(seed)
    total = sum(lengths)
    least = -(-total // capacity)
    n = len(lengths)

    def good(bins: list[list[int]]) -> bool:
        if len(bins) <= least:
            return True
        if not spare:
            return False
        room = sorted((capacity - sum(lengths[i] for i in b) for b in bins), reverse=True)
        return sum(room[max(1, int(spare * len(bins))):]) <= SETTLED * total

    population = list(population)
    while len(population) < size:
        spread = 0.0 if not population else 0.3
        order = sorted(range(n), key=lambda i: -lengths[i] * (1 + spread * (rng.random() - 0.5)))
        population.append(best_fit(order, lengths, capacity))
        if good(population[-1]):
            break
    scored = sorted(((_score(b, lengths), k, b) for k, b in enumerate(population)), key=lambda x: x[:2])
    for g in range(generations):
        if good(scored[0][2]):
            break
        children = []
        for _ in range(size // 2):
            one, two = (min(rng.sample(range(len(scored)), min(2, len(scored)))) for _ in range(2))
            for child in (crossover(scored[one][2], scored[two][2], lengths, capacity, rng),
                          mutate(scored[one][2], lengths, capacity, rng)):
                children.append((_score(child, lengths), (g + 1) * size + len(children), child))
        # One of each score, so that the parents stay different.
        unlike = {x[0]: x for x in sorted(scored + children, key=lambda x: x[:2], reverse=True)}
        scored = sorted(unlike.values(), key=lambda x: x[:2])[:size]
    return [b for _, _, b in scored]


def _packed(bins: list[list[int]], n: int) -> bytes:
    out = np.empty(n, "<i4")
    for k, b in enumerate(bins):
        out[b] = k
    return out.tobytes()


def _unpacked(raw: bytes) -> list[list[int]]:
    at = np.frombuffer(raw, "<i4")
    order = np.argsort(at, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(at[order])) + 1)] if len(at) else []


STATE = "grp long, island int, lengths array<int>, population array<binary>, n_bins int"


def _bred(state: DataFrame, capacity: int, level: int, epoch: int, spare: float) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for grp, island, lengths, population in zip(f["grp"], f["island"], f["lengths"], f["population"]):
                lengths = [int(x) for x in lengths]
                bred = evolve(lengths, [_unpacked(x) for x in population], capacity,
                              f"{level}/{epoch}/{grp}/{island}", spare=spare,
                              generations=GENERATIONS if spare else LAST_GENERATIONS)
                out.append((grp, island, lengths, [_packed(b, len(lengths)) for b in bred], len(bred[0])))
            yield pd.DataFrame(out, columns=["grp", "island", "lengths", "population", "n_bins"])

    return state.mapInPandas(run, STATE)


def pack_level(pieces: DataFrame, groups: int, capacity: int, level: int, islands: int = ISLANDS,
               epochs: int = EPOCHS) -> DataFrame:
    """One level: ``row``, ``length``, ``grp``, ``bin``, ``offset``, ``fill``."""
    dealt = pieces.select("row", "length", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(groups)).alias("grp"))
    # A group holds about GROUP_PIECES pieces, or GROUP_BINS sequences, whatever the data: dealt by hash of a row number.
    items = checkpoint(dealt.groupBy("grp").agg(
        F.sort_array(F.collect_list(F.struct(F.col("length").cast("int").alias("length"), F.col("row")))).alias("items")), "items")
    parts = min(groups * islands, max(shuffle_parts(pieces), 2 * pieces.sparkSession.sparkContext.defaultParallelism))
    state = items.select(
        "grp", F.explode(F.array(*[F.lit(k) for k in range(islands)])).alias("island"),
        F.col("items.length").alias("lengths"), F.lit([]).cast("array<binary>").alias("population"))
    for epoch in range(epochs):
        if epoch:
            # The elite of every island goes to the next island of its group.
            elite = state.select("grp", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"),
                                 F.slice("population", 1, 1).alias("guest"))
            state = state.join(elite, ["grp", "island"]).select(
                "grp", "island", "lengths", F.concat("population", "guest").alias("population"))
        state = checkpoint(_bred(state.repartition(parts, "grp", "island"), capacity, level, epoch,
                                 OPEN if groups > 1 else 0.0), "islands")
    best = state.groupBy("grp").agg(F.min_by(F.col("population")[0], F.struct("n_bins", "island")).alias("best"))

    def lay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for grp, items_, raw in zip(f["grp"], f["items"], f["best"]):
                length = np.array([x["length"] for x in items_], "i8")
                row = np.array([x["row"] for x in items_], "i8")
                at = np.frombuffer(raw, "<i4").astype("i8")
                order = np.lexsort((row, -length, at))
                length, row, at = length[order], row[order], at[order]
                ends = np.cumsum(length)
                fill = np.bincount(at, length).astype("i8")
                offset = ends - length - (np.cumsum(fill) - fill)[at]
                yield pd.DataFrame({"row": row, "length": length, "grp": grp, "bin": at, "offset": offset,
                                    "fill": fill[at]})

    return items.join(best, "grp").mapInPandas(
        lay, "row long, length long, grp long, bin long, offset long, fill long")


def _totals(pieces: DataFrame) -> tuple[int, int]:
    r = pieces.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("size")).first()
    return int(r["n"]), int(r["size"] or 0)


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``sequence_id`` and ``offset`` for every row of ``pieces`` (a table
    with a ``length`` of 1 to ``capacity``), beside all its columns.

    Every row is a piece of its own, also repeated ones. An empty table gives
    an empty result. Pieces that fill a sequence get one alone (negative ids,
    by their place in the written table)."""
    pieces = checkpoint(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    placed = [pieces.where(F.col("length") >= capacity).select(
        "row", (F.lit(-1) - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    left = pieces.where(F.col("length") < capacity).select("row", "length")
    level, (n, size) = 0, _totals(left)
    while n:
        groups = max(1, min(parts_for(n, GROUP_PIECES), size // (GROUP_BINS * capacity)))
        # The emptiest bins of each group go on; a group is small, so its ranks are too.
        grp = Window.partitionBy("grp")
        nth, bins = F.dense_rank().over(grp.orderBy("fill", "bin")), F.max("bin").over(grp) + 1
        share = F.when(F.col("fill") < int(POOR * capacity), OPEN_POOR).otherwise(OPEN)
        done = checkpoint(pack_level(left, groups, capacity, level).withColumn(
            "open", (F.col("fill") < capacity) & (nth <= F.greatest(F.lit(1.0), share * bins))), "packed")
        before, n = n, 0
        if groups > 1:
            left = done.where("open").select("row", "length")
            n, size = _totals(left)
            if n < before:
                done = done.where("not open")
            else:  # nothing gained: these bins stand
                n = 0
        placed.append(done.select("row", ((F.lit(level).cast("long") * (1 << 52)) + F.col("grp") * (1 << 14)
                                          + F.col("bin")).alias("sequence_id"), "offset"))
        level += 1
    where = placed[0]
    for p in placed[1:]:
        where = where.unionByName(p)
    return pieces.join(where, "row").drop("row")


def packed_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0,
                     id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places: ``doc_id``, ``piece``,
    ``start``, ``length``, ``ids_crc32`` (and ``ids``), ``sequence_id``,
    ``offset``. Null texts count as empty, null and repeated ids stay as they
    are, other columns are ignored, an empty table gives an empty result."""
    return pack(cut(docs, tokenizer_path, capacity, end_id, id_col, text_col, with_ids), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: ``sequence_id``, ``length`` and the ``ids``
    (little-endian unsigned 32-bit) of ``packed_documents(with_ids=True)``.
    A group is one sequence, so its size is bounded by the capacity."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))["ids"]
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"),
        F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"))
