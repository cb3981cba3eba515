"""Operator 13: cross-tokenizer alignment by products of sparse matrices.

Two tokenizers cut the same bytes. Their tokens' incidence with the bytes are
matrices A and B in compressed sparse rows (one row a token, one column a
byte), built here by hand. Row products after Gustavson give A B': for every
pair of tokens that overlap, the number of bytes they share (overlap links).
Byte offsets where a token of both ends cut the tokens into groups; the
product of the tokens' incidences with the groups gives the pairs that share a
group (shared-group links).

Neither tokenizer lets a token cross from one word to the next, so the
matrices of a text are block-diagonal, and equal words have equal blocks: the
products run over the distinct words of a slice of texts, and a text's links
are its words' links one after the other. A text outside that shape is one
block as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairnet.llm.common import narrow, text_batches
from pairnet.llm.encoders import Encoder, Kept, bounds, byte_letters, joined, laid_out, split_parts
from pairnet.session import checkpoint

SPACE = "▁"
#: Id pairs whose counts are broadcast (17 bytes each); beyond it they are joined.
BROADCAST_PAIRS = 2_000_000
#: Bytes of stored links that are counted or summed at a time.
LINK_BYTES = 4 << 20
#: Words whose ids a worker keeps for each tokenizer.
CACHE_PARTS = 200_000
#: Entries of a product that are laid out at a time.
BLOCK = 4 << 20


@dataclass
class Csr:
    """A 0/1 matrix: the columns of row ``i`` are
    ``indices[indptr[i]:indptr[i + 1]]``, in ascending order."""

    indptr: np.ndarray
    indices: np.ndarray
    columns: int

    def transposed(self) -> Csr:
        rows = np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))
        order = np.argsort(self.indices, kind="stable")
        return Csr(bounds(np.bincount(self.indices, minlength=self.columns)), rows[order], len(self.indptr) - 1)


def byte_incidence(sizes: np.ndarray) -> Csr:
    """Tokens that follow each other, of ``sizes`` bytes, by bytes."""
    at = bounds(sizes)
    return Csr(at, np.arange(at[-1]), int(at[-1]))


def group_incidence(ends: np.ndarray, cuts: np.ndarray) -> Csr:
    """Tokens with these ends by the groups that end at ``cuts``."""
    return Csr(np.arange(len(ends) + 1), np.searchsorted(cuts, ends), len(cuts))


def row_products(a: Csr, b: Csr, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Gustavson's product of ``a`` and ``b``: row ``i`` is the sum of the
    rows of ``b`` that row ``i`` of ``a`` names. Yields rows, columns and
    values of the entries, ordered, for a block of rows at a time (a block
    lays out about ``block`` entries; at least one row)."""
    size = np.diff(b.indptr)
    work = bounds(size[a.indices])[a.indptr]  # entries that the rows before lay out
    n, i = len(a.indptr) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(work, work[i] + block, "right")) - 1)
        named = a.indices[a.indptr[i]:a.indptr[j]]
        columns = laid_out(b.indices, b.indptr[named], size[named])
        rows = np.repeat(np.repeat(np.arange(i, j), np.diff(a.indptr[i:j + 1])), size[named])
        key = rows * b.columns + columns
        if (np.diff(key) < 0).any():
            key.sort(kind="stable")
        first = np.flatnonzero(np.diff(key, prepend=-1))
        key, value = key[first], np.diff(np.append(first, len(key)))
        yield key // b.columns, key % b.columns, value
        i = j


def overlap_links(a_sizes: np.ndarray, b_sizes: np.ndarray):
    """Pairs of tokens that share bytes, and how many: rows of A B'."""
    return row_products(byte_incidence(a_sizes), byte_incidence(b_sizes).transposed())


def common_ends(a_sizes: np.ndarray, b_sizes: np.ndarray) -> np.ndarray:
    return np.intersect1d(np.cumsum(a_sizes), np.cumsum(b_sizes), assume_unique=True)


def group_links(a_sizes: np.ndarray, b_sizes: np.ndarray):
    """Pairs of tokens of one group: rows of the product of their groups."""
    cuts = common_ends(a_sizes, b_sizes)
    return row_products(group_incidence(np.cumsum(a_sizes), cuts),
                        group_incidence(np.cumsum(b_sizes), cuts).transposed())


class TokenBytes:
    """The bytes of every id, one after the other, and their sizes."""

    def __init__(self, rows: list[bytes]):
        self.sizes = np.fromiter(map(len, rows), "i8", len(rows))
        self.at, self.flat = bounds(self.sizes), np.frombuffer(b"".join(rows), "u1")

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return laid_out(self.flat, self.at[ids], self.sizes[ids])


class Units:
    """The distinct words of a slice of texts (or whole texts) with their ids
    under both tokenizers and, for those whose bytes both give, their links."""

    def __init__(self, sizes, a_ids, a_n, b_ids, b_n, fits):
        self.sizes, self.a_ids, self.a_n, self.b_ids, self.b_n, self.fits = sizes, a_ids, a_n, b_ids, b_n, fits


class Aligner:
    """Aligns the ids of a byte-level BPE file (A) with those of a
    sentencepiece model (B) over a space and the text."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a, self.b = Encoder(a_path, False, CACHE_PARTS), sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = {c: b for b, c in byte_letters().items()}
        vocabulary = self.a.tok.get_vocab(with_added_tokens=False)
        added = {i: t.content for i, t in self.a.tok.get_added_tokens_decoder().items()}
        rows = [b""] * (1 + max([*vocabulary.values(), *added]))
        for entry, i in vocabulary.items():
            rows[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
        for i, entry in added.items():
            rows[i] = entry.encode()
        self.a_bytes = TokenBytes(rows)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = TokenBytes([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode()
                                   for i, p in enumerate(pieces)])
        whole = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        #: No piece goes on over a space or a line feed, and nothing is normalised away.
        self.by_word = (self.a.cached and not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in whole) and SPACE in whole
                        and self.b.normalize(" a  b ") == f"{SPACE}{SPACE}a{SPACE}{SPACE}b{SPACE}")
        self.front, self.kept = self.b.piece_to_id(SPACE), Kept(CACHE_PARTS)
        self.a_name, self.b_name = [str(i) for i in range(len(rows))], [str(i) for i in range(len(pieces))]
        #: Ids of a link as they are stored.
        self.kind = "<u2" if max(len(rows), len(pieces)) <= 1 << 16 else "<u4"

    def _b_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A part that begins with a line feed follows no space: the space
        that the model puts in front is a token of its own there."""
        rows = self.b.encode(parts, num_threads=1)
        return joined([r[1:] if p[:1] == "\n" and r[:1] == [self.front] else r for p, r in zip(parts, rows)])

    def units(self, texts: pa.Array) -> tuple[Units, np.ndarray, np.ndarray]:
        """The units of a slice of texts, each occurrence's unit, and each
        text's bounds among the occurrences. A null or empty text has none."""
        texts = pc.fill_null(texts, "")
        n = len(texts)
        filled = pc.not_equal(texts, "").to_numpy(zero_copy_only=False)
        parts, codes, at, regular = split_parts(texts)
        # The first part follows a space here, so it may not be empty, nor lead a line.
        first = codes[at[:-1]]
        lone = pc.or_(pc.equal(parts, ""), pc.starts_with(parts, "\n")).to_numpy(zero_copy_only=False)
        regular &= ~lone[first]
        if not self.by_word:
            regular[:] = False
        odd = np.flatnonzero(~regular & filled)
        keep = np.repeat(regular & filled, np.diff(at))
        used, codes = np.unique(codes[keep], return_inverse=True)
        parts = parts.take(pa.array(used))
        a_ids, a_n = self.a._parts(parts, " ")
        names = parts.to_pylist()
        b_ids, b_n = self.kept.rows(self.kept.places(names, self._b_parts))
        lead = np.fromiter((p[:1] != "\n" for p in names), bool, len(names))
        spelt = b"".join([b" " + p.encode() if s else p.encode() for p, s in zip(names, lead.tolist())])
        sizes = pc.binary_length(parts).to_numpy().astype("i8") + lead
        sizes_of_text = np.where(regular & filled, np.diff(at), 0)
        if len(odd):
            whole = [" " + t for t in texts.take(pa.array(odd)).to_pylist()]
            more_a, more_b = self.a.direct(whole), self.b.encode([t[1:] for t in whole], num_threads=1)
            raw = [t.encode() for t in whole]
            a_ids, a_n = _with(a_ids, a_n, more_a)
            b_ids, b_n = _with(b_ids, b_n, more_b)
            spelt += b"".join(raw)
            sizes = np.append(sizes, [len(r) for r in raw])
            sizes_of_text[odd] = 1
            at = bounds(sizes_of_text)
            out = np.empty(at[-1], "i8")
            place = np.ones(len(out), bool)
            place[at[odd]] = False
            out[place], out[at[odd]] = codes, len(names) + np.arange(len(odd))
            codes = out
        else:
            at = bounds(sizes_of_text)
        return self._fitting(np.frombuffer(spelt, "u1"), sizes, a_ids.astype("i8"), a_n, b_ids.astype("i8"), b_n), codes, at

    def _fitting(self, spelt, sizes, a_ids, a_n, b_ids, b_n) -> Units:
        """Units whose joined bytes under both tokenizers are their own."""
        fits, starts = np.ones(len(sizes), bool), bounds(sizes)[:-1]
        for ids, n, known in ((a_ids, a_n, self.a_bytes), (b_ids, b_n, self.b_bytes)):
            total = bounds(known.sizes[ids])[bounds(n)]
            same = np.diff(total) == sizes
            joined = known.joined(ids[np.repeat(same, n)])
            own = laid_out(spelt, starts[same], sizes[same])
            wrong = bounds(joined != own)
            at = bounds(sizes[same])
            same[same] = wrong[at[1:]] == wrong[at[:-1]]
            fits &= same
        return Units(sizes, a_ids, a_n, b_ids, b_n, fits)

    def blocks(self, u: Units):
        """Links and groups of all fitting units by the matrices of their
        joined bytes: ids of the linked tokens and their number by unit, the
        number of groups by unit, the groups' text by unit."""
        a_of, b_of = np.repeat(u.fits, u.a_n), np.repeat(u.fits, u.b_n)
        a_ids, b_ids = u.a_ids[a_of], u.b_ids[b_of]
        a_sizes, b_sizes = self.a_bytes.sizes[a_ids], self.b_bytes.sizes[b_ids]
        a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
        # Of the overlap links, those whose byte ranges end together.
        found = [(r[e], c[e]) for r, c, _ in overlap_links(a_sizes, b_sizes) for e in [a_ends[r] == b_ends[c]]]
        rows = np.concatenate([r for r, _ in found]) if found else np.empty(0, "i8")
        cols = np.concatenate([c for _, c in found]) if found else np.empty(0, "i8")
        cuts = common_ends(a_sizes, b_sizes)
        unit_ends = np.cumsum(np.where(u.fits, u.sizes, 0))
        n_links = np.bincount(np.searchsorted(unit_ends, a_ends[rows]), minlength=len(u.sizes))
        n_groups = np.bincount(np.searchsorted(unit_ends, cuts), minlength=len(u.sizes))
        text = self._texts(a_ids, np.searchsorted(a_ends, cuts, "right"), b_ids, np.searchsorted(b_ends, cuts, "right"))
        at = bounds(n_groups)
        names = [";".join(text[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
        return a_ids[rows], b_ids[cols], n_links, n_groups, names

    def _texts(self, a_ids, a_to, b_ids, b_to) -> list[str]:
        a, b = [self.a_name[i] for i in a_ids.tolist()], [self.b_name[i] for i in b_ids.tolist()]
        out, i, k = [], 0, 0
        for j, m in zip(a_to.tolist(), b_to.tolist()):
            out.append((a[i] if j == i + 1 else ",".join(a[i:j])) + "|" + (b[k] if m == k + 1 else ",".join(b[k:m])))
            i, k = j, m
        return out

    def documents(self, texts: pa.Array):
        """For each text: tokens of A, tokens of B, groups, links (numbers),
        the digest of its groups, and the linked ids (``kind``, A and B in
        turn)."""
        u, codes, at = self.units(texts)
        a, b, n_links, n_groups, names = self.blocks(u)
        misfit = bounds(~u.fits[codes])
        whole = (misfit[at[1:]] == misfit[at[:-1]]) & (np.diff(at) > 0)
        counts = [np.where(whole, bounds(x[codes])[at[1:]] - bounds(x[codes])[at[:-1]], 0)
                  for x in (u.a_n, u.b_n, n_groups, n_links)]
        pairs, starts = np.empty((len(a), 2), self.kind), bounds(n_links)
        pairs[:, 0], pairs[:, 1] = a, b
        digests, links = [], []
        for i, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            own = codes[lo:hi] if whole[i] else codes[:0]
            digests.append(hashlib.sha256(";".join([names[c] for c in own.tolist()]).encode()).hexdigest()
                           if whole[i] else "")
            links.append(laid_out(pairs, starts[own], n_links[own]).tobytes())
        return counts, digests, links


def _with(flat: np.ndarray, sizes: np.ndarray, rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return (np.concatenate([flat, *[np.array(r, flat.dtype) for r in rows]]),
            np.append(sizes, [len(r) for r in rows]).astype("i8"))


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner a worker process and pair of files."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


def _kind(a_path: str, b_path: str) -> str:
    return aligner(a_path, b_path).kind


def linked_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """One row a document: ``row`` (a number of its own), ``doc_id``, ``n_a``,
    ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256`` and ``links`` (the
    linked ids, A and B in turn, little-endian). A map over the rows."""
    rows = narrow(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for b in text_batches(batches, 4 << 20, 20_000):
            counts, digests, links = own.documents(b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts],
                 pa.array(digests, pa.string()), pa.array(links, pa.binary())], names)

    return rows.mapInArrow(run, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
                                "groups_sha256 string, links binary")


def _pairs(raw: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys (A id, then B id) of all links of a batch, and links by row."""
    sizes = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype("i8") // (2 * np.dtype(kind).itemsize)
    ids = np.frombuffer(b"".join(raw.to_pylist()), kind).reshape(-1, 2)
    return (ids[:, 0].astype("i8") << 32) | ids[:, 1], sizes


def pair_counts(linked: DataFrame, kind: str) -> DataFrame:
    """``a``, ``b``, ``n`` (links of the whole table that hold the two ids
    linked) and ``best`` (no id is linked to ``b`` more often). Counted in
    the tasks before the shuffle; at most a row for every two ids of the
    vocabularies."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, LINK_BYTES, 20_000, "links"):
            key, n = np.unique(_pairs(b.column("links"), kind)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key >> 32), pa.array(key & 0xFFFFFFFF), pa.array(n)], ["a", "b", "n"])

    counted = linked.select("links").mapInArrow(run, "a long, b long, n long") \
        .groupBy("a", "b").agg(F.sum("n").alias("n"))
    # The rows of one id of B are at most the ids of A.
    return counted.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
            broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row a document: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``,
    ``n_links`` (linked: byte ranges that end together), ``n_best`` (links
    whose ids are linked as often as any with the same id of B),
    ``count_sum`` (how often their ids are linked in all documents, over the
    links) and ``groups_sha256``.

    Null and empty texts, and texts whose joined bytes differ from a space and
    the text (a text with U+2581), have zeros and an empty digest. Null and
    repeated ids are kept as they are, one result row a document. Other
    columns are ignored. An empty table gives an empty result. Memory: a
    slice of texts (a longer text is a slice of its own) and two bounded
    caches. The id pairs' counts are broadcast only if they are counted to be
    few; otherwise documents' pairs are joined with them in a shuffle.
    """
    kind = _kind(a_path, b_path)
    linked = checkpoint(linked_documents(docs, a_path, b_path, id_col, text_col), "links")
    pairs = checkpoint(pair_counts(linked, kind), "link-counts")
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if pairs.count() <= broadcast_pairs:
        table = pairs.select(F.shiftleft("a", 32).bitwiseOR(F.col("b")).alias("key"), "n", "best").toPandas()
        table = table.sort_values("key")
        sent = docs.sparkSession.sparkContext.broadcast(
            (table["key"].to_numpy("i8"), table["n"].to_numpy("i8"), table["best"].to_numpy(bool)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, n, best = sent.value
            for b in text_batches(batches, LINK_BYTES, 20_000, "links"):
                key, sizes = _pairs(b.column("links"), kind)
                distinct, at = np.unique(key, return_inverse=True)
                place = np.searchsorted(keys, distinct)[at]
                ends = bounds(sizes)
                sums = [np.diff(bounds(x[place])[ends]) for x in (best, n)]
                held = {c: b.column(c) for c in b.schema.names} | {
                    "n_best": pa.array(sums[0], pa.int64()), "count_sum": pa.array(sums[1], pa.int64())}
                yield pa.RecordBatch.from_arrays([held[c] for c in columns], columns)

        return linked.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
                                      "count_sum long, groups_sha256 string")

    def by_pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, LINK_BYTES, 20_000, "links"):
            key, sizes = _pairs(b.column("links"), kind)
            row = np.repeat(b.column("row").to_numpy(), sizes)
            order = np.lexsort((key, row))
            key, row = key[order], row[order]
            first = np.flatnonzero(np.append(True, (np.diff(key) != 0) | (np.diff(row) != 0))[:len(key)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(row[first]), pa.array(key[first] >> 32), pa.array(key[first] & 0xFFFFFFFF),
                 pa.array(np.diff(np.append(first, len(key))))], ["row", "a", "b", "times"])

    # Both sides are plain shuffles of written tables: a hot pair's rows can be split.
    sums = linked.select("row", "links").mapInArrow(by_pair, "row long, a long, b long, times long") \
        .join(pairs.hint("merge"), ["a", "b"]).groupBy("row") \
        .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
             F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return linked.drop("links").join(sums, "row", "left").na.fill(0, ["n_best", "count_sum"]).select(*columns)


def links(docs: DataFrame, a_path: str, b_path: str, groups: bool = False, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """The links themselves, a row for every two linked tokens of a document:
    ``doc_id``, ``a_at`` and ``b_at`` (places of the tokens), ``a`` and ``b``
    (their ids), ``value`` (bytes that both hold; ``groups=True``: 1 for every
    two tokens of one group). Products run a block of rows at a time, so a
    long group is never laid out whole. Rows without an alignment have none."""
    rows = narrow(docs, id_col, text_col)
    names = ["doc_id", "a_at", "b_at", "a", "b", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for batch in text_batches(batches):
            u, codes, at = own.units(batch.column("text"))
            a_at, b_at = bounds(u.a_n), bounds(u.b_n)
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                mine = codes[at[k]:at[k + 1]]
                if not len(mine) or not u.fits[mine].all():
                    continue
                a = laid_out(u.a_ids, a_at[mine], u.a_n[mine])
                b = laid_out(u.b_ids, b_at[mine], u.b_n[mine])
                found = (group_links if groups else overlap_links)(own.a_bytes.sizes[a], own.b_bytes.sizes[b])
                for r, c, v in found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc_id] * len(r), pa.int64()), *[pa.array(x.astype("i8")) for x in (r, c, a[r], b[c], v)]],
                        names)

    return rows.mapInArrow(run, "doc_id long, a_at long, b_at long, a long, b long, value long")
