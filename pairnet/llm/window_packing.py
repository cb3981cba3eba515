"""Operator 12: packing by best-fit decreasing.

Documents longer than a window are first cut into full windows, which stand
alone; what is left of each document is one piece. Pieces go longest first
into the open window with the least room that suffices. A segment tree over
the remaining capacities finds it: a leaf holds its capacity if a window with
just that room is open, an inner node the largest capacity below it.

Pieces are dealt by hash into groups of bounded size, each packed in one task.
Windows that a group leaves poorly filled are opened again and their pieces
form the groups of the next level, until one group is left, so padding doesn't
grow with the number of groups.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairnet.llm.common import narrow, parts_for, text_batches
from pairnet.llm.encoders import encoder
from pairnet.session import checkpoint

GROUP_PIECES = 8192
#: Windows below this share of the room are opened again on the next level.
POOR = 0.96

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


class OpenWindows:
    """Open windows by remaining capacity, in a segment tree."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)  # leaf of capacity c: at size + c
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _set(self, room: int, value: int) -> None:
        tree, i = self.tree, self.size + room
        tree[i] = value
        i >>= 1
        while i:
            most = max(tree[2 * i], tree[2 * i + 1])
            if tree[i] == most:
                return
            tree[i], i = most, i >> 1

    def add(self, window: int, room: int) -> None:
        if not room:
            return
        if not self.windows[room]:
            self._set(room, room)
        self.windows[room].append(window)

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Takes out a window with the least room of at least ``length``;
        gives it and its room, or nothing."""
        tree, i = self.tree, 1
        if tree[1] < length:
            return None
        # Of the leaves with at least ``length`` room, the leftmost: an inner
        # node's left half is right exactly if it holds a capacity that suffices.
        while i < self.size:
            i = 2 * i if tree[2 * i] >= length else 2 * i + 1
        room = tree[i]
        window = self.windows[room].pop()
        if not self.windows[room]:
            self._set(room, 0)
        return window, room


def best_fit_decreasing(lengths: Iterable[int], capacity: int) -> list[int]:
    """The window of each piece; ``lengths`` in descending order."""
    open_, out, n = OpenWindows(capacity), [], 0
    for length in lengths:
        found = open_.tightest(length)
        if found is None:
            found, n = (n, capacity), n + 1
        out.append(found[0])
        open_.add(found[0], found[1] - length)
    return out


def cut(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id",
        text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every row's token ids (and ``end_id``) cut into full windows and one
    shorter piece for what is left. A null text counts as empty: one piece
    with ``end_id`` alone."""
    rows = narrow(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    end, names = struct.pack("<I", end_id), [x.split()[0] for x in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for b in text_batches(batches, 16 << 20, 20_000):
            ids = [x + end for x in enc.encode(b.column("text"))]
            total = np.fromiter(map(len, ids), "i8", len(ids)) // 4
            pieces = -(-total // capacity)
            doc = np.repeat(np.arange(len(ids)), pieces)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
            length = np.minimum(capacity, total[doc] - start)
            own = [ids[d][4 * s:4 * (s + n)] for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length),
                pa.array(list(map(zlib.crc32, own)), pa.int64()), pa.array(total[doc]),
                pa.array(own, pa.binary()) if with_ids else pa.nulls(len(own), pa.binary())], names)

    out = rows.mapInArrow(run, PIECES)
    return out if with_ids else out.drop("ids")


def pack_group(pieces: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """One group's pieces (``row``, ``length``) with their window, the place
    in it and the window's fill."""
    pieces = pieces.sort_values(["length", "row"], ascending=[False, True], kind="stable")
    window = np.array(best_fit_decreasing(pieces["length"].tolist(), capacity), "i8")
    order = np.argsort(window, kind="stable")
    window, length = window[order], pieces["length"].to_numpy("i8")[order]
    fill = np.bincount(window, length).astype("i8")
    return pd.DataFrame({"row": pieces["row"].to_numpy()[order], "window": window, "fill": fill[window],
                         "offset": np.cumsum(length) - length - (np.cumsum(fill) - fill)[window]})


def _level(pieces: DataFrame, groups: int, capacity: int, level: int) -> DataFrame:
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(groups)))

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pack_group(group, capacity).assign(grp=key[0])

    # A group holds about GROUP_PIECES rows whatever the data: dealt by hash of a row number.
    return dealt.groupBy("grp").applyInPandas(run, "row long, window long, fill long, offset long, grp long")


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """``sequence_id`` and ``offset`` for every row of ``pieces`` (a table
    with a ``length`` of 1 to ``capacity``), beside all its other columns.

    Every row is a piece of its own, also repeated ones; equal lengths go by
    their place in the written table. Full windows have negative sequence ids.
    An empty table gives an empty result."""
    clash = [c for c in ("sequence_id", "offset", "_row") if c in pieces.columns]
    pieces = checkpoint(pieces.drop(*clash).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    placed = [pieces.where(F.col("length") >= capacity).select(
        "_row", (F.lit(-1) - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    left = pieces.where(F.col("length") < capacity).select(F.col("_row").alias("row"), F.col("length").cast("long").alias("length"))
    level, n = 0, left.count()
    while n:
        groups = parts_for(n, GROUP_PIECES)
        done, total, n = checkpoint(_level(left, groups, capacity, level), "windows"), n, 0
        if groups > 1:
            poor = F.col("fill") < int(POOR * capacity)
            again = done.where(poor).select("row")
            n_again = again.count()
            # Where most windows are poor, packing the same pieces again gains nothing: they stand.
            if n_again <= total // 2:
                left = checkpoint(left.join(again, "row", "left_semi"), "left")
                done, n = done.where(~poor), n_again
        placed.append(done.select(F.col("row").alias("_row"), _sequence(level).alias("sequence_id"), "offset"))
        level += 1
    where = placed[0]
    for p in placed[1:]:
        where = where.unionByName(p)
    return pieces.join(where, "_row").drop("_row")


def _sequence(level: int) -> Column:
    return F.lit(level).cast("long") * (1 << 52) + F.col("grp") * (1 << 14) + F.col("window")


def packed_windows(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0,
                   id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places: ``doc_id``, ``start``,
    ``length``, ``ids_crc32``, ``doc_tokens`` (and ``ids``), ``sequence_id``,
    ``offset``. Null texts count as empty, null and repeated ids stay as they
    are (rows that share an id are documents of their own), other columns are
    ignored, an empty table gives an empty result. Memory: a slice of texts
    and a bounded cache in the cutting tasks, one group in the packing ones."""
    return pack(cut(docs, tokenizer_path, capacity, end_id, id_col, text_col, with_ids), capacity)


def padded(packed: DataFrame, capacity: int = 1024) -> DataFrame:
    """``sequence_id``, ``length`` and ``padding`` of every sequence: up to
    the capacity, nothing for a length that is a power of two."""
    own = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"))
    even = F.bit_count(F.col("length")) == 1
    return own.withColumn("padding", F.when(even, 0).otherwise(F.lit(capacity) - F.col("length")))
