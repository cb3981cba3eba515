"""Operator 3: token counts by heap-and-linked-list byte-pair merging.

A word's characters form a linked list; a heap holds its mergeable adjacent
pairs by rank (leftmost first among equals). The lowest-ranked live pair is
popped and merged until none is left. The count is the number of initial
symbols minus the number of merges; no id is looked up. With byte fallback, a
character outside the vocabulary stands for its UTF-8 bytes, which never
merge.

The vocabulary's pieces hold a space mark only in front, so no merge crosses
from a word into the next space; words are counted apart and their counts are
kept in a bounded cache. A vocabulary for which this does not hold is run over
whole texts.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairnet.llm.common import narrow, text_batches
from pairnet.llm.encoders import PieceCache

SPACE = "▁"


class PieceCounter:
    """Counts the pieces of a sentencepiece BPE model with the identity
    normaliser, a dummy space in front and kept white space."""

    def __init__(self, model_path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model_path)
        names = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        plain = [(i, p) for i, p in enumerate(names)
                 if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))]
        scores = sorted({m.get_score(i) for i, _ in plain}, reverse=True)
        place = {s: k for k, s in enumerate(scores)}
        self.rank = {p: place[m.get_score(i)] for i, p in plain}
        self.bytes = any(m.is_byte(i) for i in range(len(names)))
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in self.rank)
        if m.normalize(" a  b ") != f"{SPACE}{SPACE}a{SPACE}{SPACE}b{SPACE}" or not self.bytes:
            raise ValueError("the model needs the identity normaliser, a dummy prefix, kept spaces, byte fallback")
        self.cache = PieceCache()

    def merge_count(self, word: str) -> int:
        """Initial symbols minus merges of one word."""
        rank = self.rank
        sym: list[str | None] = list(word)
        n = len(sym)
        count = sum(1 if c in rank else len(c.encode()) for c in sym)
        if n < 2:
            return count
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        right[-1] = -1
        heap = []
        for i in range(n - 1):
            r = rank.get(sym[i] + sym[i + 1])
            if r is not None:
                heap.append((r, i, sym[i] + sym[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = right[i]
            if sym[i] is None or j < 0 or len(sym[i]) + len(sym[j]) != len(pair) or sym[i] + sym[j] != pair:
                continue  # one of the two has merged elsewhere since
            sym[i], sym[j] = pair, None
            count -= 1
            k = right[j]
            right[i] = k
            if k >= 0:
                left[k] = i
                r = rank.get(pair + sym[k])
                if r is not None:
                    heapq.heappush(heap, (r, i, pair + sym[k]))
            h = left[i]
            if h >= 0:
                r = rank.get(sym[h] + pair)
                if r is not None:
                    heapq.heappush(heap, (r, h, sym[h] + pair))
        return count

    def words(self, text: str) -> list[str]:
        """The text's words, each with its space marks in front."""
        if not self.by_word:
            return [SPACE + text.replace(" ", SPACE)]
        if "  " in text or SPACE in text or text[:1] == " " or text[-1:] == " ":
            return re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", SPACE + text.replace(" ", SPACE))
        return text.split(" ")  # the mark in front of each is implied

    def count(self, texts: list[str]) -> list[int]:
        split = [self.words(t) if t else [] for t in texts]
        marked = (lambda w: w) if not self.by_word else (lambda w: w if w[:1] == SPACE else SPACE + w)
        lost = self.cache.missing(chain.from_iterable(split))
        kept = self.cache.now
        for w in lost:
            kept[w] = self.merge_count(marked(w))
        get = kept.__getitem__
        return [sum(map(get, ws)) for ws in split]


_COUNTERS: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` of every row.

    A null or empty text has 0 bytes and 0 tokens. Null or repeated ids are
    kept as they are: one result row per input row. Other columns are ignored;
    an empty table gives an empty result. A map over the rows, no shuffle;
    memory is one slice of texts and the bounded cache."""
    rows = narrow(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model_path)
        for b in text_batches(batches):
            n = c.count(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pc.binary_length(b.column("text")).cast(pa.int64()),
                pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
