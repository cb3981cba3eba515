"""Operator 11 against edit distances of all pairs, on small tables."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairnet.llm import variants
from pairnet.llm.variants import letter_parts, near_pairs, spelling_forms
from test_llm import edge, small

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]
AZ = str.maketrans(variants.UPPER, variants.UPPER.lower())


def plain_words(rows, every=199):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(AZ)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % every == 0 else run] += 1
    return n


def deletions(w):
    return {w[:i] + w[i + 1:] for i in range(len(w))}


def near(words):
    """Words one edit apart, by plain neighbourhoods."""
    words, out = set(words), {w: set() for w in words}
    by_hole = {}
    for w in words:
        for d in deletions(w):
            if d in words:
                out[w].add(d)
                out[d].add(w)
        for i in range(len(w)):
            by_hole.setdefault((w[:i], w[i + 1:]), []).append(w)
    for own in by_hole.values():
        for w in own:
            out[w].update(x for x in own if x != w)
    return out


def plain_forms(rows, every=199, least_length=6, least_count=5, times=5):
    n = {w: k for w, k in plain_words(rows, every).items() if len(w) >= least_length and k >= least_count}
    form, near_to = {}, near(n)
    for w in n:
        best = min(near_to[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near_to[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_documents_brute_force(spark):
    docs = small(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert got(spelling_forms(docs)) == plain_forms(rows)
    assert got(spelling_forms(docs, typo_every=3, least_length=3, least_count=1, times=2)) == plain_forms(rows, 3, 3, 1, 2)


@pytest.mark.parametrize("parts", [3, 4, 7])
def test_every_pair_meets(spark, parts):
    rng = random.Random(parts)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))) for _ in range(1500)}
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    pairs = {frozenset((r["a"], r["b"])) for r in near_pairs(df, letter_parts(df, parts)).collect()}
    want = {frozenset((w, x)) for w, own in near(words).items() for x in own}
    assert pairs == want and near_pairs(df, letter_parts(df, parts)).count() == len(want)


def test_edges(spark):
    texts = ["Straße STRASSE straße", "ÀÉÎÕÜ àéîõü", "wordword " * 6 + "wordwor " * 40, None, "", "x", "日本語 word×word÷"] * 3
    docs = edge(spark, texts)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert got(spelling_forms(docs, least_length=1, least_count=1)) == plain_forms(rows, 199, 1, 1)
    assert spelling_forms(docs.limit(0)).count() == 0


def test_chains_and_a_hub(spark):
    """Forms of forms, and one word that half of all others are near to."""
    words = [("a" * k, 5 ** k) for k in range(6, 17)] + [("bbbbbbb", 10 ** 6)] + [
        ("bbbbbbb"[:i] + c + "bbbbbbb"[i + 1:], 7) for i in range(7) for c in "acdefghijklmnopqrstuvwxyz"]
    df = spark.createDataFrame(words, "word string, n long")
    forms = variants.nearest(df, near_pairs(df, letter_parts(df)))
    root = {r["word"]: r["root"] for r in variants.roots(forms).collect()}
    assert all(root["a" * k] == "a" * 16 for k in range(6, 16)) and "a" * 16 not in root
    assert sum(r == "bbbbbbb" for r in root.values()) == 175
    hub = forms.where(F.col("word") == "bbbbbbb").first()
    assert hub["n_near"] == 175 and hub["form"] is None
