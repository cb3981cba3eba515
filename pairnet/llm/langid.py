"""Operator 7: language ID by language-bitmask n-gram filters.

Every language has a Bloom filter of the character n-grams that belong to it;
the filters are bit-sliced: a slot holds one bit per language (a word for
every 64 languages), so one probe of
``HASHES`` slots, ANDed, gives the bitmask of all languages that contain an
n-gram. A text's per-language popcounts are corrected for the false positives
that the filter's fill makes expected, and the largest decides.

An n-gram belongs to a language if its rate there is at least ``SHARE`` of
its highest rate over all languages. Learning takes a bounded sample
(``FIT_DOCS`` documents a language, by hash of the id) and ``GRAMS`` n-grams a
language, so the filter's size is set by the number of languages; prediction takes whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pairnet.llm.common import bounded_sample, held_out, narrow, quoted, text_batches
from pairnet.session import checkpoint

#: Labelled documents a language that the fit reads.
FIT_DOCS = 3000
#: N-grams a language kept.
GRAMS = 60_000
SHARE = 0.5
SIZES = (2, 3, 4)
SLOTS = 1 << 20
HASHES = 4
#: Bytes of text worked on at a time: n-grams take some hundred times as much.
SLICE = 1 << 18
#: Languages of a mask's word.
WORD = 64
UNKNOWN = "und"

U = np.uint64


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of all texts with 0 for anything but letters and
    a 0 before each text, and where each text starts."""
    joined = "\0" + "\0".join(t.lower() for t in texts) + "\0"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    lengths = np.array([len(t.lower()) + 1 for t in texts], np.int64)
    return cp * is_letter()[cp], np.concatenate([[0], np.cumsum(lengths)])


@cache
def is_letter() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(cp: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the n-grams of ``size``: only letters inside, a
    word's edge at most at the ends, at least one letter."""
    n = len(cp) - size + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    word = cp != 0
    good = word[1:1 + n] | word[:n] if size == 2 else np.ones(n, bool)
    for k in range(1, size - 1):
        good &= word[k:k + n]
    at = np.flatnonzero(good)
    h = np.full(len(at), size, U)
    for k in range(size):
        h = (h * U(0x9E3779B97F4A7C15)) ^ (cp[at + k].astype(U) * U(0xC2B2AE3D27D4EB4F))
        h ^= h >> U(29)
    return h, at


def probes(h: np.ndarray, slots: int = SLOTS, hashes: int = HASHES) -> Iterator[np.ndarray]:
    """The slots of each hash, one array per hash function (double hashing)."""
    a, b = h * U(0xFF51AFD7ED558CCD), (h * U(0xC4CEB9FE1A85EC53)) | U(1)
    a ^= a >> U(32)
    b ^= (b >> U(32)) << U(1)
    for k in range(hashes):
        yield ((a + U(k) * b) >> U(20)) & U(slots - 1)


@dataclass(frozen=True)
class Filter:
    """Bit-sliced filters: ``slots`` masks, one bit per language."""

    languages: tuple[str, ...]
    masks: np.ndarray  # of the first WORD languages
    false_rate: np.ndarray  # chance that an n-gram outside a language passes
    more: tuple[np.ndarray, ...] = ()  # of the next ones, WORD each

    @classmethod
    def build(cls, languages: tuple[str, ...], hashes: np.ndarray, members: np.ndarray,
              words: np.ndarray | None = None) -> Filter:
        """``members``: the bits of an n-gram in the mask's word that ``words``
        gives (the first by default)."""
        kind = next((k for k in (np.uint8, np.uint16, np.uint32)
                     if np.dtype(k).itemsize * 8 >= len(languages)), np.uint64)
        masks = np.zeros((-(-len(languages) // WORD), SLOTS), kind)
        words = np.zeros(len(hashes), np.int64) if words is None else words
        for slot in probes(hashes):
            np.bitwise_or.at(masks, (words, slot.astype(np.int64)), members.astype(kind))
        fill = np.array([((masks[k // WORD] >> kind(k % WORD)) & kind(1)).mean() for k in range(len(languages))])
        return cls(languages, masks[0], fill ** HASHES, tuple(masks[1:]))

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text: corrected counts of each language's n-grams, and n-grams."""
        cp, start = letters(texts)
        hits = np.zeros((len(texts), len(self.languages)))
        total = np.zeros(len(texts))
        for size in SIZES:
            h, at = grams(cp, size)
            slots = list(probes(h))
            # The n-gram that begins at a text's leading edge is its own.
            cut = np.searchsorted(at, start)
            total += np.diff(cut)
            for k in range(len(self.languages)):
                if k % WORD == 0:
                    own = (self.masks, *self.more)[k // WORD]
                    mask = own[slots[0]]
                    for slot in slots[1:]:
                        mask = mask & own[slot]
                bit = (mask >> mask.dtype.type(k % WORD)) & mask.dtype.type(1)
                run = np.concatenate([[0], np.cumsum(bit, dtype=np.int64)])
                hits[:, k] += run[cut[1:]] - run[cut[:-1]]
        expected = total[:, None] * self.false_rate[None, :]
        return np.maximum(0, hits - expected) / (1 - self.false_rate)[None, :], total

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score (its share of all languages' counts); ``und`` and
        0 without a letter, the first language by name among equals."""
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        own = [t or "" for t in texts]
        counts, _ = self.counts(own)
        best, total = counts.argmax(1), counts.sum(1)
        known = [any(c.isalpha() for c in t) for t in own]
        share = np.where(total > 0, counts[np.arange(len(own)), best] / np.where(total > 0, total, 1),
                         1.0 / len(self.languages))
        return ([self.languages[b] if k else UNKNOWN for b, k in zip(best, known)],
                [float(s) if k else 0.0 for s, k in zip(share, known)])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filter:
    """The filter of a table's labelled rows that aren't held out.

    Rows with a null language teach nothing; without labelled rows there is no
    language and every prediction is ``und``."""
    spark = docs.sparkSession
    own = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("string").alias("text"),
                      quoted(lang_col).cast("string").alias("lang"))
    own = own.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    ids = bounded_sample(own.select("doc_id", "lang"), "lang", FIT_DOCS)
    names = [r["lang"] for r in ids.select("lang").distinct().orderBy("lang").collect()]
    if not names:
        return Filter((), np.zeros(SLOTS, np.uint8), np.zeros(0))
    # FIT_DOCS ids a language; the size check decides on a broadcast.
    chosen = own.join(ids.distinct(), ["doc_id", "lang"], "left_semi").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, SLICE, 1 << 20):
            langs = np.array(b.column("lang").to_pylist(), object)
            texts = b.column("text").to_pylist()
            for lang in sorted(set(langs)):
                cp, _ = letters([texts[i] for i in np.flatnonzero(langs == lang)])
                for size in SIZES:
                    h, n = np.unique(grams(cp, size)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(h), pa.string()), pa.array(np.full(len(h), size, "i4")),
                         pa.array(h.view(np.int64)), pa.array(n.astype("i8"))], ["lang", "size", "gram", "n"])

    counted = chosen.mapInArrow(count, "lang string, size int, gram long, n long") \
        .groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")).where("n > 1")
    counted = checkpoint(counted, "grams")
    totals = counted.groupBy("lang", "size").agg(F.sum("n").alias("all"))
    rate = counted.join(F.broadcast(totals), ["lang", "size"]).withColumn("rate", F.col("n") / F.col("all"))
    top = rate.groupBy("size", "gram").agg(F.max("rate").alias("top"))
    members = rate.join(top, ["size", "gram"]).where(F.col("rate") >= SHARE * F.col("top"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    kept = members.withColumn("nth", nth).where(F.col("nth") <= GRAMS).select("lang", "gram")
    # GRAMS rows a language.
    got = kept.toPandas()
    place = {name: k for k, name in enumerate(names)}
    at = np.array([place[x] for x in got["lang"]], np.int64)
    return Filter.build(tuple(names), got["gram"].to_numpy().astype(np.int64).view(U),
                        U(1) << (at % WORD).astype(U), at // WORD)


def predict(docs: DataFrame, model: Filter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` of every row, from
    whole texts alone. A null text or one without a letter is ``und`` with
    score 0. Ids may be null or repeated, other columns are ignored, an empty
    table gives an empty result. A map over the rows with a broadcast filter
    (1 MB for up to 8 languages, 8 MB for every 64)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = narrow(docs, id_col, text_col).select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, SLICE):
            lang, score = shared.value.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(lang), pa.array(score)],
                ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def with_language(docs: DataFrame, model: Filter, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has a language by the model (any but
    ``und``), with all their columns: those with a letter, also by a model that
    learned no language and so can't name one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [f.name for f in docs.schema]
    if keep.count(text_col) == 1 and docs.schema[text_col].dataType == StringType():
        own, at = docs, keep.index(text_col)  # read in place: no second copy of the texts
    else:
        name = "own text"
        while name in docs.columns:
            name += " "
        own, at = docs.withColumn(name, quoted(text_col).cast("string")), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = []
            only = pa.RecordBatch.from_arrays([b.column(at)], ["text"])
            for part in text_batches([only], SLICE):
                texts = part.column(0).to_pylist()
                if shared.value.languages:
                    known += [x != UNKNOWN for x in shared.value.predict(texts)[0]]
                else:
                    known += [any(c.isalpha() for c in t or "") for t in texts]
            yield b.select(list(range(len(keep)))).filter(pa.array(known, pa.bool_()))

    return own.mapInArrow(run, docs.schema)
