"""Operator 10: toxicity by noisy-channel deobfuscation.

A suspicious token (a digit or symbol before, among or after its letters, a
letter three times in a row, or a run of single characters) is a lattice: each character stands
for itself, for a letter that it resembles, for a masked letter, or for
nothing (a repetition or a separator), each with the channel's probability.
The Viterbi path under a character language model is the restored word. The
words of the restored text are scored: features (words and their beginnings)
with a significant log-odds ratio between toxic and other labelled documents
form a lexicon, and a document's strongest features go through a calibrated
logistic function.

The language model counts letters and character 2-, 3- and 4-grams of every
whole document into tables of fixed size; a mask may stand for any letter
counted. The lexicon is learned from a bounded
sample of labelled rows (``FIT_DOCS`` by hash of the id) outside the held-out
fold. Only text is an input of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairnet.llm.common import fewest, held_out, narrow, quoted, text_batches
from pairnet.llm.encoders import PieceCache
from pairnet.llm.langid import letters
from pairnet.session import checkpoint

#: Labelled documents that the fit reads at most.
FIT_DOCS = 12_000
#: Features kept in the lexicon, the least documents of one, and the least
#: log-likelihood ratio (about one chance in 10 million).
LEXICON = 5000
LEAST_DOCS = 4
LEAST_LLR = 14.0
#: Beginnings of words that are features, in letters.
STEMS = (4, 5, 6)

# Letters that a symbol resembles.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
MASKS = "*#%"
#: Channel: log probabilities of what a character stands for.
LOOK, MASK, DROP_SYMBOL = (math.log(p) for p in (0.5, 0.08, 0.15))
#: A letter like the one before it: drawn out or meant, if it stands in a run
#: of three or more, and else.
REPEAT = {True: (math.log(0.6), math.log(0.4)), False: (math.log(0.005), math.log(0.995))}

U = np.uint64
#: Slots of the tables of letters (one for each code point of the planes that
#: have letters) and of 2-, 3- and 4-grams.
TABLES = {1: 1 << 18, 2: 1 << 13, 3: 1 << 16, 4: 1 << 19}
CHUNK = 1 << 12
#: Probabilities that a character model keeps, those of letters in order, and
#: letters that may follow a context ranked at once.
KNOWN, AFTER, FIRST = 200_000, 1 << 20, 32
#: States that the search of one token takes for an exact path, those that it
#: takes for each step on beyond them, and the letters whose ranking counts as
#: one more.
STATES, STRIDE, RANKED = 30_000, 100, 256


# --- character language model ------------------------------------------------

def _slots(codes: list[np.ndarray], size: int) -> np.ndarray:
    if size == 1:
        return codes[0].astype(np.int64)
    h = np.full(len(codes[0]), size, U)
    for c in codes:
        h = (h * U(0x9E3779B97F4A7C15)) ^ (c.astype(U) * U(0xC2B2AE3D27D4EB4F))
        h ^= h >> U(31)
    return (h & U(TABLES[size] - 1)).astype(np.int64)


def _slot(gram: str) -> int:
    """The same for one n-gram."""
    h = len(gram)
    for c in gram:
        h = (h * 0x9E3779B97F4A7C15 ^ (0 if c == "\0" else ord(c)) * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF
        h ^= h >> 31
    return h & (TABLES[len(gram)] - 1)


def count_grams(texts: list[str], tables: dict[int, np.ndarray]) -> None:
    """Adds the texts' n-grams; a word is its letters between two edges (0)."""
    cp, _ = letters(texts)
    word = cp != 0
    for size, table in tables.items():
        n = len(cp) - size + 1
        if n <= 0:
            continue
        good = np.ones(n, bool)  # an edge only first or last
        for k in range(1, size - 1):
            good &= word[k:k + n]
        good &= word[:n] | word[size - 1:size - 1 + n]
        at = np.flatnonzero(good)
        table += np.bincount(_slots([cp[at + k] for k in range(size)], size), minlength=len(table))


class CharModel:
    """Interpolated 4-gram probabilities from the hashed count tables."""

    def __init__(self, tables: dict[int, np.ndarray]):
        self.tables, self.known = tables, {}
        self.codes = np.flatnonzero(tables[1])
        self.alphabet, self.ordered, self.ranked, self.read = [chr(c) for c in self.codes], {}, 0, {}

    def _count(self, gram: str) -> float:
        return float(self.tables[len(gram)][_slot(gram)])

    def logp(self, context: str, c: str) -> float:
        """Of ``c`` after the last three characters (``\\0``: a word's edge)."""
        got = self.known.get((context, c))
        if got is None:
            if len(self.known) > KNOWN:
                self.known.clear()
            p = 1 / 64
            for size in (3, 4):
                if len(context) >= size - 1:
                    before = self._count(context[-(size - 1):])
                    p = (self._count(context[-(size - 1):] + c) + 4 * p) / (before + 4)
            got = self.known[context, c] = math.log(min(1.0, max(p, 1e-9)))
        return got

    def after(self, context: str, nth: int) -> tuple[float, str]:
        """The ``nth`` letter of the alphabet after the last three characters
        by falling ``logp`` (of equals the smaller first). The first ``FIRST``
        are ranked alone; few searches need more."""
        got = self.ordered.get(context)
        if got is None or nth >= len(got):
            p = np.full(len(self.codes), 1 / 64)
            for size in (3, 4):
                if len(context) >= size - 1:
                    last = context[-(size - 1):]
                    codes = [np.full(len(self.codes), 0 if c == "\0" else ord(c)) for c in last]
                    n = self.tables[size][_slots([*codes, self.codes], size)]
                    p = (n + 4 * p) / (self._count(last) + 4)
            p = np.log(np.clip(p, 1e-9, 1.0))
            at = np.arange(len(p))
            if nth < FIRST < len(p):
                at = np.flatnonzero(p >= np.partition(p, len(p) - FIRST)[len(p) - FIRST])
            at = at[np.argsort(-p[at], kind="stable")]
            if nth < FIRST:
                at = at[:FIRST]
            if self.ranked > AFTER:
                self.ordered.clear()
                self.ranked = 0
            self.ranked += len(at)
            got = self.ordered[context] = [(float(p[k]), self.alphabet[k]) for k in at]
        return got[nth]


# --- channel -------------------------------------------------------------------

def parts(token: str) -> Iterator[tuple[tuple[str, bool], ...]]:
    """The token's characters, each with whether it stands in a run of three
    or more, cut where three different letters in a row follow a choice: there
    the context is the same on every path, so the cut changes no path."""
    own, open_, fixed = [], False, 0
    for m in re.finditer(r"(.)\1*", token, re.DOTALL):
        c, n = m[1], m.end() - m.start()
        own += [(c, n > 2)] * n
        open_ |= not c.isalpha() or n > 1
        fixed = 0 if not c.isalpha() else min(fixed, 2) + 1 if n == 1 else 1
        if fixed == 3 and open_:
            yield tuple(own)
            own, open_ = [], False
    if own:
        yield tuple(own)


def restore(token: str, model: CharModel) -> str:
    """The most probable word behind a lower-case token: the Viterbi path over
    the lattice of what each character may stand for, found part by part.
    The letters up to the first choice are on every path. The path is exact
    for a token whose search takes at most ``STATES`` states. A longer search
    (hundreds of masks and look-alikes in one token) goes on in strides: after
    every ``STRIDE`` states the best path to the farthest place reached is
    settled, so that time and memory stay in proportion to the length and
    every character is still read."""
    first = next((k for k, c in enumerate(token) if not c.isalpha() or token[k + 1:k + 2] == c), len(token))
    out, start, left = [token[:first]], ("\0" + token[:first])[-3:], STATES
    cut = list(parts(token[first:]))
    for k, part in enumerate(cut):
        key = start, part, k == len(cut) - 1
        got = model.read.get(key)
        if got is None or got[1] > left != STATES:  # what is kept is exact or had all states to take
            got = _best(*key, left, model)
            if left == STATES or got[1] <= left:
                if len(model.read) > KNOWN:
                    model.read.clear()
                model.read[key] = got
        out.append(got[0])
        start, left = (start + got[0])[-3:], max(STRIDE, left - got[1])
    return "".join(out)


def _best(start: str, part: tuple[tuple[str, bool], ...], last: bool, most: int, model: CharModel) -> tuple[str, int]:
    """The letters of the best path for a part after the context ``start``,
    and the states taken. The ``last`` part of a token ends at a word's edge.
    A state is a place and the last three letters; states are taken by their
    cost and the least cost of the characters that are left, so the first end
    is the best of all paths. A mask's letters come one by one, by falling
    probability. After ``most`` states it goes on in strides."""
    steps, least = [], [0.0]
    for c, drawn in part:
        emit = [(c, 0.0)] if c.isalpha() else [(x, math.log(len(LOOKS[c])) - LOOK) for x in LOOKS.get(c, "")]
        drop, masked = None if c.isalpha() else -DROP_SYMBOL, c in MASKS
        steps.append((emit, drop, masked, *(-x for x in REPEAT[drawn])))
    for emit, drop, masked, *_ in reversed(steps):
        least.append(least[-1] + min([x for _, x in emit] + [-MASK] * masked + [drop] * (drop is not None)))
    least.reverse()  # of the characters from each place on
    rank = len(model.alphabet) // RANKED
    # (bound, place counted backwards, word, context, cost, next letter of a mask or -1)
    heap, done = [(least[0], 0, "", start, 0.0, -1)], set()
    settled, taken, stop = [], 0, most
    while True:
        if taken > stop:  # settle the best path to the farthest place
            _, at, word, context, *_ = min(heap, key=lambda state: (state[1], state[0]))
            settled.append(word)
            if at < -len(steps):
                return "".join(settled), taken
            heap, done, stop = [(least[-at], at, "", context, 0.0, -1)], set(), taken + STRIDE
        _, at, word, context, cost, nth = heappop(heap)
        taken += 1
        if at == -len(steps) - 1 or at == -len(steps) and not last:
            return "".join([*settled, word]), taken
        if nth < 0:
            if (at, context) in done:
                continue
            done.add((at, context))
        if at == -len(steps):
            cost -= model.logp(context, "\0")
            heappush(heap, (cost, at - 1, word, context, cost, -1))
            continue
        emit, drop, masked, once, again = steps[-at]
        left = least[1 - at]
        if nth >= 0:  # a mask's letter, and the next one's turn
            p, x = model.after(context, nth)
            own = cost - MASK - p + (again if x == context[-1] else 0.0)
            heappush(heap, (own + left, at - 1, word + x, (context + x)[-3:], own, -1))
            nth += 1
        else:
            if drop is not None:
                heappush(heap, (cost + drop + left, at - 1, word, context, cost + drop, -1))
            for x, own in emit:
                own += cost
                if x == context[-1]:  # the same letter, drawn out
                    heappush(heap, (own + once + left, at - 1, word, context, own + once, -1))
                    own += again
                own -= model.logp(context, x)
                heappush(heap, (own + left, at - 1, word + x, (context + x)[-3:], own, -1))
            nth = 0  # a mask that draws the letter out costs more than one dropped
            taken += rank * masked
        if masked and nth < len(model.alphabet):
            heappush(heap, (cost - MASK - model.after(context, nth)[0] + left, at, word, context, cost, nth))


_WORD = re.compile(r"[^\W\d_]+")
#: A letter, then a symbol or digit, then a letter or look-alike; look-alikes
#: or masks in front of a letter; a letter three times.
_SUSPECT = re.compile(r"[^\W\d_][^\w\s]*[\d@$!|+(€£*#%._\-][^\w\s]*[^\W_]|^[\d@$!|+(€£*#%]+[^\W\d_]|([^\W\d_])\1\1")
_EDGE = ".,;:?\"'()[]{}<>-_"
_TRAIL = re.compile(r"(?:(\W)\1{2,}|!+)$")
_DRAWN = re.compile(r"(.)\1{2,}")
_TRIPLE = re.compile(r"(.)\1\1")
#: Single characters in a row that make a spaced-out word.
SPACED = 2
#: Look-alikes and masks that end a token.
_END = re.compile("[" + re.escape("".join(LOOKS) + MASKS) + "]+$")


def suspects(token: str) -> list[str]:
    """The cores of a lower-case token that the channel may have changed: with
    the look-alikes and masks at its end (they may be its last letters), and
    without (they may be decoration)."""
    core = token.strip(_EDGE)
    if core.isalpha():
        return [_DRAWN.sub(r"\1\1\1", core)] if _TRIPLE.search(core) else []
    whole = token.lstrip(_EDGE).rstrip(_EDGE.replace("(", ""))
    own = [whole] if _END.search(whole) else []
    for cut in (_TRAIL, _END):
        bare = cut.sub("", core).strip(_EDGE)
        if _SUSPECT.search(bare):
            own.append(bare)
    return list(dict.fromkeys(_DRAWN.sub(r"\1\1\1", x) for x in own if any(c.isalpha() for c in x)))


def spaced(tokens: list[str]) -> list[str]:
    """Words spelt as single characters, joined; as a neighbouring one-letter
    word may be joined with them, also without the first or last one."""
    lengths = list(map(len, tokens))
    out, at, n = [], 0, len(tokens)
    while True:
        try:
            at = lengths.index(1, at)
        except ValueError:
            return out
        end = at
        while end < n and lengths[end] == 1:
            end += 1
        if end - at >= SPACED:
            joined = _DRAWN.sub(r"\1\1", "".join(tokens[at:end]))
            if len(set(joined)) > 1 and any(c.isalpha() for c in joined):
                out += [joined, joined[1:], joined[:-1]] if len(joined) > 2 else [joined]
        at = end


def token_words(token: str, model: CharModel) -> list[str]:
    """The words of a lower-case token, as written and as restored."""
    plain = token.strip(_EDGE)
    words = [plain] if plain.isalpha() else _WORD.findall(token)
    if len(words) == 1 and words[0] == plain and not _TRIPLE.search(plain):
        return words
    return [*words, *[restore(core, model) for core in suspects(token)]]


def restore_text(text: str, model: CharModel) -> str:
    """The lower-cased text with every suspicious token and every spaced-out
    word replaced by its restoration."""
    tokens, out, at = text.lower().split(), [], 0
    while at < len(tokens):
        end = at
        while end < len(tokens) and len(tokens[end]) == 1:
            end += 1
        run = spaced(tokens[at:end])
        if run:
            out.append(restore(run[0], model))
            at = end
            continue
        cores = suspects(tokens[at])
        out.append(restore(cores[0], model) if cores else tokens[at])
        at += 1
    return " ".join(out)


def features(word: str) -> list[str]:
    return [word, *[word[:n] + "~" for n in STEMS if len(word) > n]]


# --- the model -------------------------------------------------------------------

@dataclass(frozen=True)
class Toxicity:
    tables: dict[int, np.ndarray]
    lexicon: dict[str, float]
    weights: tuple[float, float, float]  # intercept, strongest, number of hits

    def strength(self, token: str, model: CharModel) -> float:
        """The log-odds of a token's strongest feature (0: none)."""
        get, best = self.lexicon.get, 0.0
        for w in token_words(token, model):
            for f in features(w):
                best = max(best, get(f, 0.0))
        return best

    def hits(self, texts: list[str], model: CharModel, kept: PieceCache) -> list[tuple[float, int]]:
        """Of each whole text the strongest feature's log-odds and the number
        of distinct tokens with one; strengths of tokens are kept in ``kept``."""
        split = [t.lower().split() for t in texts]
        distinct = [{*tokens, *spaced(tokens)} for tokens in split]
        for token in kept.missing(chain.from_iterable(distinct)):
            kept.now[token] = self.strength(token, model)
        get, out = kept.now.__getitem__, []
        for tokens in distinct:
            strong = [s for s in map(get, tokens) if s]
            out.append((max(strong, default=0.0), len(strong)))
        return out

    def score(self, best: float, n: int) -> float:
        a, b, c = self.weights
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * best + c * min(n, 5)))))


def language_model(docs: DataFrame, text_col: str = "text") -> dict[int, np.ndarray]:
    """Count tables of all whole texts. A task sends its tables once, cut into
    chunks, and each chunk is summed in a stream; the tables that reach the
    driver have a fixed size (7 MB)."""
    rows = docs.select(quoted(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {size: np.zeros(n, np.int64) for size, n in TABLES.items()}
        for b in text_batches(batches, 1 << 20):
            count_grams(b.column("text").to_pylist(), tables)
        for size, table in tables.items():
            used = [k for k in range(0, len(table), CHUNK) if table[k:k + CHUNK].any()]
            if used:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([size] * len(used), pa.int32()), pa.array(used, pa.int32()),
                     pa.array([table[k:k + CHUNK].astype("<i8").tobytes() for k in used], pa.binary())],
                    ["size", "at", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for size, at, n in zip(b.column("size").to_pylist(), b.column("at").to_pylist(), b.column("n").to_pylist()):
                got = np.frombuffer(n, "<i8")
                sums[size, at] = sums[size, at] + got if (size, at) in sums else got
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int32()),
                 pa.array([v.astype("<i8").tobytes() for v in sums.values()], pa.binary())], ["size", "at", "n"])

    schema = "size int, at int, n binary"
    summed = rows.mapInArrow(count, schema).repartition("size", "at").mapInArrow(add, schema)
    tables = {size: np.zeros(n, np.int64) for size, n in TABLES.items()}
    for r in checkpoint(summed, "char-counts").toLocalIterator():
        tables[r["size"]][r["at"]:r["at"] + CHUNK] += np.frombuffer(bytes(r["n"]), "<i8")
    return tables


def _newton(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression of weighted rows."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * (y - p)) - ridge * w
        h = (x * (n * p * (1 - p))[:, None]).T @ x + (ridge + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w + np.clip(step, -2, 2)
        if abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_id: str = "doc_id", label_col: str = "toxic") -> Toxicity:
    """Learns from labelled rows that aren't held out. Null labels and null
    ids teach nothing; several labels of one id count as the largest. With no
    toxic or no other row every score is below one half."""
    spark = docs.sparkSession
    tables = language_model(docs, text_col)
    shared = spark.sparkContext.broadcast(tables)
    marked = labels.select(quoted(label_id).cast("long").alias("doc_id"), quoted(label_col).cast("int").alias("y")) \
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    marked = checkpoint(marked.groupBy("doc_id").agg(F.max("y").alias("y")), "labels")
    # Top-k by hash of the id: bounded, so the join below may broadcast it.
    sample = checkpoint(fewest(marked, "doc_id", marked.count(), FIT_DOCS), "sample")
    texts = narrow(docs, id_col, text_col).where(F.col("text").isNotNull()).join(F.broadcast(sample), "doc_id")

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, counts = CharModel(shared.value), Counter()
        for b in text_batches(batches):
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
                tokens = text.lower().split()
                own = {f for t in {*tokens, *spaced(tokens)} for w in token_words(t, model) for f in features(w)}
                counts.update((f, y) for f in own)
            if len(counts) > 400_000:
                yield _counted(counts)
                counts = Counter()
        if counts:
            yield _counted(counts)

    counted = texts.select("text", "y").mapInArrow(present, "feature string, y int, n long") \
        .groupBy("feature").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("pos"),
                                F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("neg"))
    size = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    pos_n, neg_n = float(size.get(1, 0)), float(size.get(0, 0))
    if not pos_n or not neg_n:
        return Toxicity(tables, {}, (-1.0, 0.0, 0.0))
    share = pos_n / (pos_n + neg_n)
    n = F.col("pos") + F.col("neg")
    rate = F.col("pos") / n

    def side(k, r, base):
        return F.when(k > 0, k * F.log(r / F.lit(base))).otherwise(0.0)

    llr = side(F.col("pos"), rate, share) + side(F.col("neg"), 1 - rate, 1 - share)
    odds = F.log((F.col("pos") + 0.5) / F.lit(pos_n + 1)) - F.log((F.col("neg") + 0.5) / F.lit(neg_n + 1))
    top = counted.where((n >= LEAST_DOCS) & (rate > share)).withColumn("llr", llr).where(F.col("llr") >= LEAST_LLR) \
        .orderBy(F.col("llr").desc(), "feature").limit(LEXICON).select("feature", odds.alias("odds"))
    lexicon = {r["feature"]: r["odds"] for r in top.collect()}

    rough = Toxicity(tables, lexicon, (0.0, 0.0, 0.0))
    shared2 = spark.sparkContext.broadcast(rough)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, kept = CharModel(shared2.value.tables), PieceCache()
        for b in text_batches(batches):
            got = shared2.value.hits(b.column("text").to_pylist(), model, kept)
            yield pa.RecordBatch.from_arrays(
                [pa.array([round(x, 1) for x, _ in got], pa.float64()), pa.array([min(k, 5) for _, k in got], pa.int32()),
                 b.column("y")], ["best", "n", "y"])

    # One row per rounded strength, number of hits (0 to 5) and label: a few hundred.
    cells = texts.select("text", "y").mapInArrow(measure, "best double, n int, y int").groupBy("best", "n", "y") \
        .count().toPandas()
    if not len(cells):
        return Toxicity(tables, {}, (-1.0, 0.0, 0.0))
    x = np.stack([np.ones(len(cells)), cells["best"], cells["n"]], axis=1).astype(float)
    w = _newton(x, cells["y"].to_numpy(float), cells["count"].to_numpy(float))
    return Toxicity(tables, lexicon, tuple(float(v) for v in w))


def _counted(counts: Counter) -> pa.RecordBatch:
    keys = list(counts)
    return pa.RecordBatch.from_arrays(
        [pa.array([f for f, _ in keys]), pa.array([y for _, y in keys], pa.int32()),
         pa.array([counts[k] for k in keys], pa.int64())], ["feature", "y", "n"])


def scores(docs: DataFrame, model: Toxicity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every row from
    its whole text (null: empty, scored like a text without any hit). Ids may
    be null or repeated; other columns are ignored; an empty table gives an
    empty result. A map over the rows with a broadcast model of fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = narrow(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"),
                                                 held_out(F.col("doc_id")).alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        chars, kept = CharModel(own.tables), PieceCache()
        for b in text_batches(batches):
            got = [own.score(*x) for x in own.hits(b.column("text").to_pylist(), chars, kept)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(got, pa.float64()),
                 pa.array([int(x >= 0.5) for x in got], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
