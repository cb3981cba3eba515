"""Operator 13 against products and intervals written plainly."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairnet.llm import alignment
from pairnet.llm.alignment import Csr, aligned, aligner, row_products
from test_llm import BPE, EDGE_TEXTS, PIECES, edge, small

BITS = ["a", "B", "é", "\n", "\t", " ", " ", " ", "  ", ".", ",", "'s", "1", "word", "中", "-", " ", "<|endoftext|>",
        "\n\n", "\r\n", "▁", "　", "<s>", "\0", "<0x41>", "😀", "\n", " the", " of"]


def plain(own, text):
    """Tokens of both, common ends, groups and links of one text."""
    none = ([], [], 0, [], "")
    if not text:
        return none
    a = own.a.tok.encode(" " + text, add_special_tokens=False).ids
    b = own.b.encode(text)
    spelt = [[bytes(k.flat[k.at[i]:k.at[i + 1]]) for i in ids] for k, ids in ((own.a_bytes, a), (own.b_bytes, b))]
    if any(b"".join(s) != (" " + text).encode() for s in spelt):
        return none
    ends = [np.cumsum([len(x) for x in s]).tolist() for s in spelt]
    groups, i, k = [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        j, m = ends[0].index(cut) + 1, ends[1].index(cut) + 1
        groups.append(",".join(map(str, a[i:j])) + "|" + ",".join(map(str, b[k:m])))
        i, k = j, m
    links = [(a[p], b[ends[1].index(e)]) for p, e in enumerate(ends[0]) if e in ends[1]]
    return a, b, len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()


def expected(own, texts):
    each = [plain(own, t) for t in texts]
    n = Counter(x for e in each for x in e[3])
    best = {}
    for (_, b), k in n.items():
        best[b] = max(best.get(b, 0), k)
    return sorted((len(a), len(b), g, len(x), sum(n[p] == best[p[1]] for p in x), sum(n[p] for p in x), d)
                  for a, b, g, x, d in each)


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("block", [1, 5, 1 << 20])
def test_row_products(block):
    rng = np.random.default_rng(1)
    for _ in range(30):
        a, b = rng.random((rng.integers(1, 9), 6)) < 0.4, rng.random((6, rng.integers(1, 9))) < 0.4
        csr = [Csr(np.concatenate([[0], np.cumsum(m.sum(axis=1))]), np.nonzero(m)[1], m.shape[1]) for m in (a, b)]
        got = np.zeros((len(a), b.shape[1]), int)
        for r, c, v in row_products(*csr, block):
            assert (got[r, c] == 0).all()
            got[r, c] = v
        assert (got == a.astype(int) @ b.astype(int)).all()
        back = csr[0].transposed()
        assert (np.repeat(np.arange(6), np.diff(back.indptr)) == np.nonzero(a.T)[0]).all()
        assert (back.indices == np.nonzero(a.T)[1]).all()


def test_links_of_two_tokenizations():
    a, b = np.array([3, 2, 1, 4]), np.array([1, 4, 5])
    overlap = {(r, c): v for x in alignment.overlap_links(a, b) for r, c, v in zip(*(y.tolist() for y in x))}
    assert overlap == {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 1, (3, 2): 4}
    assert alignment.common_ends(a, b).tolist() == [5, 10]
    shared = {(r, c) for x in alignment.group_links(a, b) for r, c in zip(x[0].tolist(), x[1].tolist())}
    assert shared == {(0, 0), (0, 1), (1, 0), (1, 1), (2, 2), (3, 2)}


def test_texts_equal_the_plain_alignment(monkeypatch):
    monkeypatch.setattr("pairnet.llm.encoders.CACHE_PARTS", 50)
    own = alignment.Aligner(BPE, PIECES)
    rng = np.random.default_rng(3)
    texts = EDGE_TEXTS + ["".join(rng.choice(BITS, rng.integers(0, 12))) for _ in range(2500)]
    for k in range(0, len(texts), 50):
        part = texts[k:k + 50]
        counts, digests, links = own.documents(pa.array(part, pa.string()))
        for i, t in enumerate(part):
            a, b, g, x, d = plain(own, t)
            assert [c[i] for c in counts] == [len(a), len(b), g, len(x)] and digests[i] == d
            assert np.frombuffer(links[i], own.kind).reshape(-1, 2).tolist() == [list(p) for p in x]


@pytest.mark.parametrize("broadcast", [alignment.BROADCAST_PAIRS, 0])
def test_alignment_brute_force(spark, broadcast):
    docs = edge(spark).unionByName(small(spark).limit(40), allowMissingColumns=True)
    got = sorted(tuple(r[c] for c in COLUMNS) for r in aligned(docs, BPE, PIECES, broadcast_pairs=broadcast).collect())
    assert got == expected(aligner(BPE, PIECES), [r["text"] for r in docs.select("text").collect()])
    assert aligned(docs.limit(0), BPE, PIECES, broadcast_pairs=broadcast).count() == 0


def test_hot_pair_is_split(spark, monkeypatch):
    """A third of all link rows on one pair of ids: AQE splits the join's shuffle."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the same "), F.hex("id")).alias("text")).repartition(8)
    for key, value in {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k", "spark.sql.shuffle.partitions": "16",
                       "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.autoBroadcastJoinThreshold": "-1",
                       "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k"}.items():
        spark.conf.set(key, value)
    try:
        out = aligned(docs, BPE, PIECES, broadcast_pairs=0)
        out.write.format("noop").mode("overwrite").save()
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in ("skewJoin.skewedPartitionThresholdInBytes", "skewJoin.skewedPartitionFactor", "advisoryPartitionSizeInBytes"):
            spark.conf.unset(f"spark.sql.adaptive.{key}")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_link_tables(spark):
    docs = edge(spark, repeat=False).where(F.length("text") < 1000)
    own, texts = aligner(BPE, PIECES), {r["doc_id"]: r["text"] for r in docs.collect()}
    for groups in (False, True):
        got = Counter((r["doc_id"], r["a"], r["b"], r["value"])
                      for r in alignment.links(docs, BPE, PIECES, groups).collect())
        want = Counter()
        for doc_id, t in texts.items():
            a, b, n, _, _ = plain(own, t)
            ends = [np.cumsum([k.sizes[i] for i in ids]).tolist() for k, ids in ((own.a_bytes, a), (own.b_bytes, b))]
            cuts = sorted(set(ends[0]) & set(ends[1]))
            for p, x in enumerate(a):
                for q, y in enumerate(b):
                    lo = max(ends[0][p] - own.a_bytes.sizes[x], ends[1][q] - own.b_bytes.sizes[y])
                    shared = min(ends[0][p], ends[1][q]) - lo
                    same = np.searchsorted(cuts, ends[0][p]) == np.searchsorted(cuts, ends[1][q])
                    if same if groups else shared > 0:
                        want[doc_id, x, y, 1 if groups else int(shared)] += 1
        assert got == want
