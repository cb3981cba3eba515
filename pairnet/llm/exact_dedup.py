"""Operator 4: exact dedup with static binary-fuse filters per snapshot.

A batch's texts are normalised (A-Z lower-cased) and digested. Duplicates
inside the batch are grouped on their own. The batch's distinct digests are
screened by the filter of every earlier snapshot, which is immutable: digests
that the filter rejects are certainly new, the others join the snapshot's
exact bucket and add to the group there. Every group of two or more rows is then checked byte for byte:
the texts of a group are compared, and a group whose texts differ (equal
digests of different texts) is split by its texts.

Digests are dealt by a prefix into buckets of bounded size; a filter is one
row per bucket. Groups are aggregated map-side, so a text with a third of all
rows sends one row a task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairnet.llm.common import atoms, narrow, nested, parts_for, quoted, text_batches
from pairnet.operators.screens import screened
from pairnet.session import checkpoint

BUCKET_KEYS = 1 << 16
BATCHES = 2


def sha256(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


# --- the filter -----------------------------------------------------------

def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (murmur3's fixed multipliers) over key plus seed."""
    h = keys + np.uint64(seed & 0xFFFFFFFFFFFFFFFF)
    for shift, by in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return h ^ (h >> np.uint64(33))


class BinaryFuse:
    """A static filter of 64-bit keys: three places in neighbouring segments
    whose XOR is the key's 16-bit fingerprint. No false negatives; false
    positives 1 in 65 536."""

    def __init__(self, segment: int, segments: int, seed: int, cells: np.ndarray):
        self.segment, self.segments, self.seed, self.cells = segment, segments, seed, cells

    @staticmethod
    def _places(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
        first = ((h >> np.uint64(32)) * np.uint64(segment * segments)) >> np.uint64(32)
        mask, seg = np.uint64(segment - 1), np.uint64(segment)
        second = (first + seg) ^ ((h >> np.uint64(18)) & mask)
        third = (first + seg + seg) ^ (h & mask)
        return np.stack([first, second, third]).astype(np.int64)

    @staticmethod
    def _print(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFFFF)).astype(np.uint16)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        keys = np.unique(keys.astype(np.uint64))
        n = max(2, len(keys))
        segment = 1 << max(2, min(18, int(math.log(n) / math.log(3.33) + 2.25)))
        factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
        for seed in range(1, 200):
            segments = max(1, math.ceil(n * factor / segment) - 2)
            h = _mix(keys, seed * 0x9E3779B97F4A7C15)
            order = cls._peel(cls._places(h, segment, segments), segment * (segments + 2))
            if order is None:
                factor *= 1.02
                continue
            cells, at, prints = np.zeros(segment * (segments + 2), np.uint16), cls._places(h, segment, segments), cls._print(h)
            for which, cell in reversed(order):
                a, b, c = at[:, which]
                # The cell itself is still zero, so it drops out of the XOR.
                cells[cell] = prints[which] ^ cells[a] ^ cells[b] ^ cells[c]
            return cls(segment, segments, seed, cells)
        raise RuntimeError("no filter found")

    @staticmethod
    def _peel(at: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Rounds of keys that are alone in a cell, or None when stuck."""
        n = at.shape[1]
        ids = np.arange(n)
        count = np.bincount(at.ravel(), minlength=size)
        held = np.zeros(size, np.int64)
        for row in at:
            np.bitwise_xor.at(held, row, ids)
        rounds, left = [], n
        while left:
            cell = np.flatnonzero(count == 1)
            which, first = np.unique(held[cell], return_index=True)
            if not len(which):
                return None
            rounds.append((which, cell[first]))
            left -= len(which)
            for row in at[:, which]:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(held, row, which)
        return rounds

    def contains(self, keys: np.ndarray) -> np.ndarray:
        h = _mix(keys.astype(np.uint64), self.seed * 0x9E3779B97F4A7C15)
        a, b, c = self._places(h, self.segment, self.segments)
        return self.cells[a] ^ self.cells[b] ^ self.cells[c] == self._print(h)

    def to_bytes(self) -> bytes:
        return np.array([self.segment, self.segments, self.seed], "<i8").tobytes() + self.cells.astype("<u2").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> BinaryFuse:
        segment, segments, seed = (int(x) for x in np.frombuffer(raw, "<i8", 3))
        return cls(segment, segments, seed, np.frombuffer(raw, "<u2", offset=24))


def _keys(digests) -> np.ndarray:
    """64-bit filter keys of hexadecimal digests."""
    return np.array([int.from_bytes(hashlib.blake2b(d.encode(), digest_size=8).digest(), "little")
                     for d in digests], np.uint64)


# --- batches and snapshots ------------------------------------------------

def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            digest: Callable[[bytes], str] = sha256, with_text: bool = False) -> DataFrame:
    """``doc_id`` and the hexadecimal ``digest`` of each row's normalised text
    (A-Z lower-cased; null: the empty text), on request with that text."""
    rows = narrow(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches):
            # bytes.lower() changes A-Z alone.
            texts = [t.lower() for t in b.column("text").cast(pa.binary()).to_pylist()]
            columns, names = [b.column("doc_id"), pa.array([digest(t) for t in texts])], ["doc_id", "digest"]
            if with_text:
                columns, names = [*columns, pa.array(texts, pa.binary()).cast(pa.string())], [*names, "text"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, "doc_id long, digest string" + ", text string" * with_text)


class Snapshot:
    """The digests that are new in one batch (``digest``, ``n_rows``, ``best``:
    their largest id) with a filter per bucket, both written once and never
    changed."""

    def __init__(self, groups: DataFrame):
        self.groups = checkpoint(groups.select("digest", "n_rows", "best"), "snapshot")
        self.n_buckets = parts_for(self.groups.count(), BUCKET_KEYS)
        keyed = self.groups.withColumn("bucket", self.bucket())

        def build(f: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"bucket": f["bucket"][:1], "filter": [BinaryFuse.build(_keys(f["digest"])).to_bytes()]})

        self.filters = checkpoint(keyed.select("bucket", "digest").groupBy("bucket").applyInPandas(
            build, "bucket long, filter binary"), "filters")

    def bucket(self):
        return F.pmod(F.xxhash64("digest"), F.lit(self.n_buckets))

    def screen(self, groups: DataFrame) -> DataFrame:
        """Rows of ``groups`` whose digest may be in the snapshot."""
        keyed, columns = groups.withColumn("bucket", self.bucket()), list(groups.columns)

        def run(f: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            if not len(own) or not len(f):
                return f[columns][:0]
            return f[columns][BinaryFuse.from_bytes(own["filter"].iloc[0]).contains(_keys(f["digest"]))]

        return keyed.groupBy("bucket").cogroup(self.filters.groupBy("bucket")).applyInPandas(run, groups.schema)

    def known(self, groups: DataFrame) -> DataFrame:
        """Digests of ``groups`` that the snapshot really holds: positives of
        the filter joined with the exact bucket."""
        return self.screen(groups.select("digest")).join(self.groups, "digest", "left_semi")


def exact_groups(docs: DataFrame, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text",
                 digest: Callable[[bytes], str] = sha256) -> DataFrame:
    """One row per input row: ``doc_id``, ``digest``, ``keep_id``,
    ``group_size``, ``kept``.

    Of rows with equal normalised texts the one with the largest ``doc_id``
    stays; where several rows share that id (or all ids are null), each of them
    is marked kept and ``kept_documents`` takes one. A null text is the
    empty text, a null id is smaller than any other. Other columns are
    ignored; an empty table gives an empty result. ``batches``: in how many
    arrivals the table is worked; results are the same for any number."""
    rows = checkpoint(digests(docs, id_col, text_col, digest)
                      .withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches))), "digests")
    snapshots: list[Snapshot] = []
    members = None  # each batch's digests with the snapshot (owner) whose group they are in
    for k in range(batches):
        fresh = rows.where(F.col("batch") == k).groupBy("digest").agg(F.count(F.lit(1)).alias("n_rows"),
                                                                      F.max("doc_id").alias("best"))
        parts = []
        for owner, s in enumerate(snapshots):
            fresh = checkpoint(fresh, "batch")
            held = checkpoint(s.known(fresh), "held")
            parts.append((owner, fresh.join(held, "digest", "left_semi")))
            fresh = fresh.join(held, "digest", "left_anti")
        if k + 1 < batches:
            snapshots.append(Snapshot(fresh))
            fresh = snapshots[-1].groups
        for owner, part in [*parts, (k, fresh)]:
            part = part.select("digest", F.lit(k).alias("batch"), F.lit(owner).alias("owner"), "n_rows", "best")
            members = part if members is None else members.unionByName(part)
    # One row a batch for every group.
    whole = Window.partitionBy("owner", "digest")
    members = checkpoint(members.select("digest", "batch", F.max("best").over(whole).alias("keep_id"),
                                        F.sum("n_rows").over(whole).alias("group_size")), "members")
    repeated = checkpoint(members.where("group_size > 1").select("digest").distinct(), "repeated")

    # Byte checks: the texts of every group with two or more rows.
    wanted = rows.join(repeated, "digest", "left_semi") \
        .select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct()
    # Only texts whose digest may be repeated are shuffled.
    texts = screened(digests(docs, id_col, text_col, digest, with_text=True), [F.col("digest")], repeated, [F.col("digest")])
    texts = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["_id"]) & (F.col("digest") == F.col("_digest"))) \
        .select("doc_id", "digest", "text")
    same = F.min("text").eqNullSafe(F.max("text"))
    differ = checkpoint(texts.groupBy("digest").agg(same.alias("same")).where("not same").select("digest"), "differ")
    m = members.withColumnsRenamed({"digest": "_d", "batch": "_b"})
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    out = rows if differ.isEmpty() else rows.join(differ, "digest", "left_anti")
    out = out.join(m, (F.col("digest") == F.col("_d")) & (F.col("batch") == F.col("_b"))) \
        .select("doc_id", "digest", "keep_id", "group_size", kept)
    if differ.isEmpty():
        return out
    # Equal digests of different texts: these rows go by their texts.
    keyed = texts.join(differ, "digest", "left_semi")
    g = keyed.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")) \
        .withColumnsRenamed({"digest": "_d", "text": "_t"})
    return out.unionByName(keyed.join(g, (F.col("digest") == F.col("_d")) & (F.col("text") == F.col("_t"))).select(
        "doc_id", "digest", "keep_id", "group_size", kept))


def kept_documents(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay by ``groups``: one row, whole, for every
    group of equal texts (of rows that also share the id, the first by all
    columns that can be ordered)."""
    stay = groups.where("kept").select(F.col("doc_id").alias("stay"), "digest").distinct()
    own = nested(docs, own=quoted(id_col).cast("long"), sha=F.sha2(normalised(quoted(text_col)), 256))
    joined = own.join(stay, F.col("own").eqNullSafe(F.col("stay")) & (F.col("sha") == F.col("digest")))
    nth = F.row_number().over(Window.partitionBy("own", "sha").orderBy(*atoms(docs)))
    return joined.withColumn("nth", nth).where("nth = 1").select("doc.*")


def normalised(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else (null: empty)."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), upper, upper.lower())
