"""Token ids of whole texts by the ``tokenizers`` library, a slice of texts at
a time.

A byte-level BPE tokenizer with the GPT-2 pre-tokenizer starts a new word at
every space that a non-space follows, and at every line feed between
non-spaces. So a slice of texts is split there and dictionary-encoded by Arrow,
every distinct part is encoded once, and NumPy lays the parts' ids out again by
the dictionary's codes. Texts or tokenizers outside that shape (other white
space, runs of spaces or of three line feeds, a special string in the text,
another normaliser or pre-tokenizer) go through the library whole.
"""

from __future__ import annotations

import json
import os
from itertools import chain, filterfalse, repeat
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cores (parts without the marks at their end) whose ids a worker keeps.
CACHE_PARTS = 250_000
#: Marks that end a word; none is a letter, a digit, white space or an apostrophe.
MARKS = ".,;:!?*&%$#|-"
#: Letters below this point are letters in every Unicode version.
SETTLED = "ɐ"


class PieceCache:
    """Two generations: what was used since the last turn survives a turn."""

    def __init__(self, limit: int = 250_000):
        self.limit, self.now, self.before = limit, {}, {}

    def missing(self, parts) -> set:
        """Of ``parts``, those that have to be computed; makes room first."""
        if len(self.now) > self.limit:
            self.now, self.before = {}, self.now
        lost = set(filterfalse(self.now.__contains__, parts))
        if self.before and lost:
            before = self.before
            found = {p: before[p] for p in lost if p in before}
            self.now.update(found)
            lost.difference_update(found)
        return lost


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary:
    printable Latin-1 for itself, the others in turn from U+0100."""
    plain = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace()]
    other = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


def laid_out(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``flat[start:start + size]`` of all pairs, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(total)]


def bounds(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype("i8")


class Kept:
    """Rows of ids by string, in one growing array. When it holds more than
    ``limit`` strings, it keeps those that the present call asks for."""

    def __init__(self, limit: int | None = None):
        self.limit, self.place = limit, {}
        self.flat, self.used, self.sizes, self.n = np.empty(1 << 16, "u4"), 0, np.empty(1 << 12, "i8"), 0

    def _room(self, ids: int, rows: int) -> None:
        for name, used, more in (("flat", self.used, ids), ("sizes", self.n, rows)):
            held = getattr(self, name)
            if used + more > len(held):
                new = np.empty(2 * (used + more), held.dtype)
                new[:used] = held[:used]
                setattr(self, name, new)

    def places(self, strings: list[str], compute) -> np.ndarray:
        """The row of every (distinct) string; ``compute`` gives the ids of a
        list of strings that are not there yet, one after the other, and their
        sizes."""
        if len(self.place) > (self.limit or CACHE_PARTS):
            old, at = self.place, bounds(self.sizes[:self.n])
            again = [s for s in strings if s in old]
            rows = np.array([old[s] for s in again], "i8")
            sizes = self.sizes[rows]
            flat = laid_out(self.flat, at[rows], sizes)
            self.place = {s: k for k, s in enumerate(again)}
            self.flat, self.used, self.sizes, self.n = flat, len(flat), sizes, len(sizes)
        at = np.fromiter(map(self.place.get, strings, repeat(-1)), "i8", len(strings))
        new = np.flatnonzero(at < 0)
        if len(new):
            lost = [strings[i] for i in new.tolist()]
            flat, sizes = compute(lost)
            self._room(len(flat), len(lost))
            self.flat[self.used:self.used + len(flat)] = flat
            self.sizes[self.n:self.n + len(lost)] = sizes
            self.place.update(zip(lost, range(self.n, self.n + len(lost))))
            at[new] = np.arange(self.n, self.n + len(lost))
            self.used, self.n = self.used + len(flat), self.n + len(lost)
        return at

    def rows(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the given rows, one after the other, and their sizes."""
        at = bounds(self.sizes[:self.n])
        sizes = self.sizes[places]
        return laid_out(self.flat, at[places], sizes), sizes


#: A regular part: a line feed or nothing, then no white space.
PART = r"^\n?[^\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*$"


def flags(x: pa.Array) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False)


def strings_of(x: pa.Array) -> list[str]:
    """``to_pylist`` by way of NumPy, which is several times as fast."""
    return x.to_numpy(zero_copy_only=False).tolist()


def joined(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ids one after the other, and their sizes."""
    sizes = np.fromiter(map(len, rows), "i8", len(rows))
    return np.fromiter(chain.from_iterable(rows), "u4", int(sizes.sum())), sizes


def split_parts(texts: pa.Array, special: list[str] = ()) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The parts of a slice of texts (no nulls): the distinct parts, each
    occurrence's code, each text's bounds among the occurrences, and which
    texts are regular. A part follows a space or begins with a line feed; the
    first one of a text follows nothing. In a regular text no word of the
    pre-tokenizer crosses from one part to the next, and only the first part
    may be empty."""
    lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
    at = lists.offsets.to_numpy().astype("i8")
    words = lists.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
    at -= at[0]
    codes, parts = words.indices.to_numpy(), words.dictionary
    odd = ~flags(pc.match_substring_regex(parts, PART))
    for s in special:
        odd |= flags(pc.match_substring(parts, s))
    empty, alone = flags(pc.equal(parts, "")), flags(pc.equal(parts, "\n"))
    bad = odd[codes]
    inner = np.ones(len(codes), bool)  # not the first part of its text
    inner[at[:-1]] = False
    bad |= empty[codes] & inner
    single = np.flatnonzero(alone[codes])
    if len(single):
        # A line feed alone ends the text (and no other stands before it) or
        # is followed by one that leads a word.
        led = flags(pc.starts_with(parts, "\n")) & ~alone
        ends = np.append(~inner, True)[single + 1]
        after, before = np.append(codes, codes[-1:])[single + 1], codes[single - 1]
        bad[single] |= np.where(ends, inner[single] & alone[before], ~led[after])
    regular = np.add.reduceat(bad, at[:-1]) == 0 if len(texts) else np.zeros(0, bool)
    return parts, codes, at, regular


class Encoder:
    """``encode_flat(texts)`` gives the ids of all texts one after the other
    and each text's bounds; the ids equal
    ``Tokenizer.encode(text, add_special_tokens=False)``. ``specials=False``:
    special strings in a text are plain text. ``keep``: parts whose ids it
    keeps."""

    def __init__(self, path: str, specials: bool = True, keep: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = not specials
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        self.special = [t["content"] for t in added] if specials else []
        self.cached = (
            not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding")
            and pre.get("type") == "ByteLevel" and pre.get("add_prefix_space") is False
            and pre.get("use_regex", True) and spec["model"].get("dropout") in (None, 0)
            and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized")
                        or any(c.isspace() for c in t["content"]) for t in added)
        )
        self.merge, self.letters, self.keep = self.tok.model.tokenize, byte_letters(), keep
        self.forget()

    def forget(self) -> None:
        """Drops all parts it keeps."""
        self.rest, self.heads, self.tails = Kept(self.keep), Kept(self.keep), Kept(self.keep)

    def direct(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _direct_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return joined(self.direct(texts))

    def _cores(self, cores: list[str], lead: str) -> tuple[np.ndarray, np.ndarray]:
        """A word of letters is one word of the pre-tokenizer, which the
        library's model merges alone; others take the whole way."""
        front, letters = self.letters[32] if lead else "", self.letters
        words, at, other = [], [], []
        for i, c in enumerate(cores):
            if c.isalpha() and (c.isascii() or max(c) < SETTLED):
                words.append(front + (c if c.isascii() else c.encode().decode("latin-1").translate(letters)))
                at.append(i)
            elif c:
                other.append(i)
        merged = list(map(self.merge, words))
        sizes = np.zeros(len(cores), "i8")
        sizes[at] = own = np.fromiter(map(len, merged), "i8", len(merged))
        ids = np.fromiter(map(attrgetter("id"), chain.from_iterable(merged)), "u4", int(own.sum()))
        if not other:
            return ids, sizes
        ids_other, own_other = self._direct_flat([lead + cores[i] for i in other])
        sizes[other] = own_other
        starts = np.zeros(len(cores), "i8")
        starts[at], starts[other] = bounds(own)[:-1], len(ids) + bounds(own_other)[:-1]
        return laid_out(np.concatenate([ids, ids_other]), starts, sizes), sizes

    def _parts(self, parts: pa.Array, lead: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of distinct parts that follow ``lead``."""
        feed = flags(pc.starts_with(parts, "\n"))
        bare = pc.ascii_ltrim(parts, "\n")
        cores = pc.ascii_rtrim(bare, MARKS)
        # Marks are words of their own only after a word of letters.
        cores = pc.if_else(pc.utf8_is_alpha(cores), cores, bare)
        more = flags(pc.less(pc.binary_length(cores), pc.binary_length(bare)))
        tails = pa.array([b[n:] for b, n in zip(strings_of(bare.filter(pa.array(more))),
                                                pc.utf8_length(cores.filter(pa.array(more))).to_numpy().tolist())], pa.string())
        break_ids = np.array(self.direct(["\n"])[0], "u4")
        starts, sizes, flats, shift = np.zeros((len(parts), 3), "i8"), np.zeros((len(parts), 3), "i8"), [break_ids], len(break_ids)
        sizes[:, 0] = feed * len(break_ids)
        after = feed if lead else np.ones(len(parts), bool)  # a core that follows no space
        for column, rows, strings, kept, compute in (
                (1, ~after, cores.filter(pa.array(~after)), self.rest, lambda s: self._cores(s, lead)),
                (1, after, cores.filter(pa.array(after)), self.heads, lambda s: self._cores(s, "")),
                (2, more, tails, self.tails, self._direct_flat)):
            coded = strings.dictionary_encode()
            flat, size = kept.rows(kept.places(strings_of(coded.dictionary), compute))
            code = coded.indices.to_numpy()
            starts[rows, column], sizes[rows, column] = shift + bounds(size)[code], size[code]
            flats.append(flat)
            shift += len(flat)
        return laid_out(np.concatenate(flats), starts.ravel(), sizes.ravel()), sizes.sum(axis=1)

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n = len(texts)
        if not n:
            return np.empty(0, "u4"), np.zeros(1, "i8")
        if not self.cached:
            rows = self.direct(texts.to_pylist())
            return np.concatenate([np.array(r, "u4") for r in rows]), bounds(np.array([len(r) for r in rows]))
        parts, codes, at, regular = split_parts(texts, self.special)
        odd = np.flatnonzero(~regular)
        if len(odd):
            texts_odd = texts.take(pa.array(odd)).to_pylist()
            texts = pc.if_else(pa.array(regular), texts, "")
            parts, codes, at, _ = split_parts(texts)
        heads = np.unique(codes[at[:-1]])
        # Parts of a text's beginning follow nothing: codes of their own.
        place = np.full(len(parts), -1, "i8")
        place[heads] = np.arange(len(heads))
        flat_rest, size_rest = self._parts(parts, " ")
        flat_head, size_head = self._parts(parts.take(pa.array(heads)), "")
        codes = codes.astype("i8")
        codes[at[:-1]] = len(parts) + place[codes[at[:-1]]]
        size, flat = np.concatenate([size_rest, size_head]), np.concatenate([flat_rest, flat_head])
        sizes = size[codes]
        ids = laid_out(flat, bounds(size)[codes], sizes)
        ends = bounds(sizes)[at]
        if len(odd):
            rows = dict(zip(odd.tolist(), self.direct(texts_odd)))
            pieces = [np.array(rows[i], "u4") if i in rows else ids[ends[i]:ends[i + 1]] for i in range(n)]
            ids, ends = np.concatenate(pieces), bounds(np.array([len(p) for p in pieces]))
        return ids, ends

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit bytes."""
        ids, at = self.encode_flat(pa.array(texts, pa.string()))
        raw = ids.astype("<u4").tobytes()
        return [raw[4 * a:4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, specials: bool = True) -> Encoder:
    """One encoder a worker process and file; its cache outlives a task that
    doesn't ``forget`` it."""
    if (path, specials) not in _ENCODERS:
        _ENCODERS[path, specials] = Encoder(path, specials)
    return _ENCODERS[path, specials]
