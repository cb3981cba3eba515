"""Operator 11: spelling variants by PartEnum signatures.

A word's letters form a multiset, a binary vector with a dimension for every
letter and occurrence. Words that differ by one replaced letter are two apart
in Hamming distance, by one inserted or deleted letter one apart. The letters
are dealt into parts of about equal weight; vectors at most two apart agree on
all parts but two, whichever two those are, so a word enumerates a signature
for every two parts left out (for every one part, for words one longer or
shorter): what the vector holds in the other parts. Words with an equal
signature are joined and verified by edit distance.

Signatures also hold the length of the words and one half of their letters in
order: a single edit leaves the first half or the last as it was. That loses
no pair and keeps words apart that are spelt with the same letters otherwise.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairnet.llm.common import narrow
from pairnet.session import checkpoint

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Fixed values of the query: one occurrence in 199 loses a letter.
TYPO_EVERY = 199
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: Parts that the letters are dealt to.
PARTS = 4


def lower_ascii(run: Column) -> Column:
    """A-Z lower-cased, other letters as they are."""
    return F.when(F.octet_length(run) == F.char_length(run), F.lower(run)) \
        .otherwise(F.translate(run, UPPER, UPPER.lower()))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", typo_every: int = TYPO_EVERY) -> DataFrame:
    """``word``, ``n``: the runs of letters of all texts, lower-cased (A-Z),
    with a letter deleted where ``typo_every`` divides the checksum of the
    document's id and the run."""
    doc_id, run = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("run")
    runs = narrow(docs, id_col, text_col).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run")) \
        .select(doc_id.alias("doc_id"), lower_ascii(run).alias("run")) \
        .select("run", F.crc32(F.concat("doc_id", F.lit(":"), run).cast("binary")).alias("h"))
    at = F.pmod(F.col("h"), F.char_length("run").cast("long")).cast("int")
    word = F.when(F.col("h") % typo_every == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))) \
        .otherwise(run)
    return runs.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def letter_parts(words: DataFrame, parts: int = PARTS) -> list[str]:
    """The letters of all words, dealt to ``parts`` of about equal weight (one
    row a letter comes to the driver: the alphabet is bounded)."""
    weights = words.select(F.explode(F.split("word", "")).alias("letter")).where(F.col("letter") != "") \
        .groupBy("letter").agg(F.count(F.lit(1)).alias("n")).collect()
    own, load = [""] * parts, [0] * parts
    for r in sorted(weights, key=lambda r: (-r["n"], r["letter"])):
        k = load.index(min(load))
        own[k], load[k] = own[k] + r["letter"], load[k] + r["n"]
    return own


def signatures(words: DataFrame, parts: list[str], longer: bool) -> DataFrame:
    """``signature``, ``word``, ``n``. Two words of one length that differ by a
    replaced letter share a signature. Of two words one longer and shorter,
    the shorter has it among its own, the other with ``longer=True``."""
    k = len(parts)
    letters = F.array_join(F.array_sort(F.split("word", "")), "")
    held = [F.translate(letters, "".join(p for j, p in enumerate(parts) if j != i), "") for i in range(k)]
    words = words.select("word", "n", F.char_length("word").alias("size"), *[h.alias(f"p{i}") for i, h in enumerate(held)])

    def rows(left_out: int, size: Column) -> list[Column]:
        """For a word and another of ``size`` letters (as many, or one less):
        what both have in front, or at the end, wherever the edit is."""
        half = F.floor(size / 2).cast("int")
        halves = [F.substring("word", F.lit(1), half),
                  F.substring("word", F.char_length("word") - (size - half) + 1, size - half)]
        return [F.xxhash64(F.lit(left_out), size, F.lit(side), part, F.lit("/".join(map(str, out))),
                           *[F.col(f"p{i}") for i in range(k) if i not in out])
                for out in combinations(range(k), left_out) for side, part in enumerate(halves)]

    size = F.col("size")
    own = rows(2, size) + rows(1, size - 1 if longer else size)
    return words.select(F.explode(F.array(*own)).alias("signature"), "word", "n")


def near_pairs(words: DataFrame, parts: list[str]) -> DataFrame:
    """``a``, ``n_a``, ``b``, ``n_b``: every two words that differ by one
    inserted, deleted or replaced letter, once (the shorter, or else the
    smaller, is ``a``)."""
    left = signatures(words, parts, False).toDF("signature", "a", "n_a")
    right = signatures(words, parts, True).toDF("signature", "b", "n_b")
    # Both sides are plain shuffles: the rows of a common signature can be split.
    size_a, size_b = F.char_length("a"), F.char_length("b")
    met = left.hint("merge").join(right, "signature").where((size_a < size_b) | ((size_a == size_b) & (F.col("a") < F.col("b"))))
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b").distinct()


def nearest(words: DataFrame, pairs: DataFrame, times: int = TIMES) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form`` and ``form_n``: its most frequent
    near word (ties: the first in code-point order) where that is at least
    ``times`` as frequent, else null."""
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("other_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("other_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                    F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))
    found = F.coalesce(-F.col("best.minus") >= times * F.col("n"), F.lit(False))
    return words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(found, F.col("best.other")).alias("form"), F.when(found, -F.col("best.minus")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root`` of the words that have a form: the last form of
    their chain. Every round doubles the step, and a form is ``TIMES`` as
    frequent as its word, so the rounds grow with the logarithm of the
    logarithm of the largest count."""
    step = checkpoint(forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = checkpoint(step.join(onward, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        step = new.drop("moved")
        if new.where("moved").isEmpty():
            return step


def spelling_forms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", typo_every: int = TYPO_EVERY,
                   least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES,
                   parts: int = PARTS) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of every
    word of at least ``least_length`` letters and ``least_count`` occurrences.

    A null or empty text has no words. A null id counts as empty in the
    checksum; repeated rows and ids count each. Other columns are ignored. An
    empty table, or one without such words, gives an empty result. No
    Python in the tasks; rows are counted before they are shuffled, a word
    meets others only under an equal signature."""
    counted = word_counts(docs, id_col, text_col, typo_every)
    words = checkpoint(counted.where((F.char_length("word") >= least_length) & (F.col("n") >= least_count)), "words")
    forms = checkpoint(nearest(words, near_pairs(words, letter_parts(words, parts)), times), "forms")
    return forms.join(roots(forms), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
