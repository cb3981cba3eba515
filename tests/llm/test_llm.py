"""The training-data operators against brute force, the libraries' own
results, round trips and held-out accuracy, on small tables and sf0.001."""

import hashlib
import random
import shutil
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from conftest import SF_SMALL
from oracle_check import compare
from pairnet.llm import ann, common, exact_dedup, langid, mixing, oracle, packing, queries, simhash, suffix_dedup
from pairnet.llm import token_count, token_files, toxicity
from pairnet.llm.components import components
from pairnet.llm.encoders import Encoder, PieceCache

BPE, PIECES = queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("piece_bpe_32k.model")
#: Extra columns named like results and internals of the operators.
CLASH = "size long, digest string, row long, block long, fp long, kept boolean, doc string, copies long, nth int, own long"
SCHEMA = f"doc_id long, text string, lang string, source string, {CLASH}"
LONG = "word of a very long text " * 4000
EDGE_TEXTS = [None, "", " ", "a", "A", "The same text, in four words or more.", "the same text, in four words or more.",
              "x  y\n\t z", "<|endoftext|> b", "日本語 😀 é", "12 34 !!", LONG, "▁ a▁b", "a \n b", "\0", "it's 'll"]


def edge(spark, texts=EDGE_TEXTS, repeat=True):
    rows = [(k, t, ("en", "fr", None)[k % 3], ("s1", None, "s0")[k % 3]) for k, t in enumerate(texts)]
    if repeat:
        rows += [rows[5], rows[5], (None, "no id", None, None), (None, None, None, "s1")]
    return spark.createDataFrame([r + (7, "x", 1, 2, 3, True, "d", 4, 5, 6) for r in rows], SCHEMA)


def small(spark):
    return common.documents(spark, SF_SMALL)


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# 1
def repeats(docs, length):
    least, out = {}, []
    for i, b in docs:
        for k in range(len(b) - length + 1):
            w = b[k:k + length]
            least[w] = min(least.get(w, i), i)
    for i, b in docs:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if least[b[k:k + length]] < i:
                gone[k:k + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


REPEAT_COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("hot", [20_000, 2])
def test_suffix_dedup_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(4)
    words = ["ab", "aba", "b", "ba", "é", "aaa"]
    texts = ["".join(rng.choice(words) + rng.choice(" \0") for _ in range(rng.randrange(60))) for _ in range(60)]
    texts += [texts[3], "x" + texts[4] + "y", "a" * 300, "a" * 120, None, ""]
    df = spark.createDataFrame([(k, t, "z") for k, t in enumerate(texts)], "doc_id long, text string, kept string")
    want = repeats([(k, (t or "").encode()) for k, t in enumerate(texts)], 12)
    got = suffix_dedup.remove_repeats(df, 12, with_text=True)
    assert rows_of(got, *REPEAT_COLUMNS) == want
    for r in got.collect():
        raw = (texts[r["doc_id"]] or "").encode()
        assert len(raw) - sum(s["end"] - s["start"] for s in r["spans"]) == len(r["kept"])


def test_suffix_dedup_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 40_000)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 60_000)
    docs = [(r["doc_id"], (r["text"] or "").encode()) for r in small(spark).collect()]
    assert rows_of(suffix_dedup.remove_repeats(small(spark)), *REPEAT_COLUMNS) == repeats(docs, 50)


def test_suffix_dedup_of_one_hot_id_fills_many_blocks(spark, monkeypatch):
    """A third of the rows without an id, in several blocks: the same result."""
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 40_000)
    docs = [(None if k % 3 == 0 else r["doc_id"], r["text"]) for k, r in enumerate(small(spark).orderBy("doc_id").collect())]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).cache()
    n, size = common.input_bytes(df)
    wanted = common.parts_for(size + n, 40_000)
    none = df.where("doc_id is null")
    blocks = none.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(wanted)).alias("b")).groupBy("b").count()
    assert wanted > 4 and blocks.agg(F.max("count")).first()[0] < none.count() / 2
    want = repeats([(suffix_dedup.NO_ID if k is None else k, (t or "").encode()) for k, t in docs], 50)
    got = rows_of(suffix_dedup.remove_repeats(df).fillna({"doc_id": suffix_dedup.NO_ID}), *REPEAT_COLUMNS)
    assert got == want


def test_suffix_dedup_edges(spark):
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(edge(spark)).collect() if r["doc_id"] is not None}
    assert got[0]["n_bytes"] == 0 and got[0]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[5]["n_removed"] == 0  # rows that share an id don't remove each other
    assert suffix_dedup.remove_repeats(edge(spark).limit(0)).count() == 0


def test_intervals_share_their_prefix():
    text = np.frombuffer(b"abracadabra abracadabra\0abra", np.uint8).astype(np.int64) + 1
    order, opens = suffix_dedup.shared_intervals(text, 4)
    raw = (text - 1).astype(np.uint8).tobytes()
    for r in range(1, len(raw)):
        a, b = raw[order[r - 1]:][:4], raw[order[r]:][:4]
        if len(a) == len(b) == 4:
            assert (a == b) == (not opens[r])


# 2
def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 40)  # several groups and levels
    monkeypatch.setattr(packing, "GROUP_BINS", 2)
    docs = small(spark)
    got = packing.packed_documents(docs, BPE, 512, with_ids=True)
    rows = got.collect()
    enc = Encoder(BPE)
    ids = {r["doc_id"]: enc.encode([r["text"] or ""])[0] + b"\0\0\0\0" for r in docs.collect()}
    bins = {}
    for r in rows:
        own = ids[r["doc_id"]][4 * r["start"]:4 * (r["start"] + r["length"])]
        assert own == bytes(r["ids"]) and zlib.crc32(own) == r["ids_crc32"]
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 512
    total = sum(r["length"] for r in rows)
    assert total == sum(len(x) // 4 for x in ids.values())
    assert len(bins) <= 1.02 * -(-total // 512) + 1
    per = Counter((r["doc_id"], r["length"] == 512) for r in rows)
    assert all(n <= 1 for (_, full), n in per.items() if not full)
    for s in packing.sequences(got).collect():
        assert len(s["ids"]) == 4 * s["length"]


def test_packing_edges(spark):
    rows = packing.packed_documents(edge(spark), BPE, 64).collect()
    assert sum(r["doc_id"] == 0 for r in rows) == 1 and sum(r["doc_id"] == 5 for r in rows) == 3
    assert packing.packed_documents(edge(spark).limit(0), BPE).count() == 0


def test_genetic_operators_keep_every_piece():
    rng = random.Random(1)
    lengths = [rng.randrange(1, 100) for _ in range(120)]
    bred = packing.evolve(lengths, [], 100, "s", generations=10)
    for bins in bred:
        assert sorted(i for b in bins for i in b) == list(range(120))
        assert all(sum(lengths[i] for i in b) <= 100 for b in bins)
    assert len(bred[0]) == min(map(len, bred))
    again = packing._unpacked(packing._packed(bred[0], 120))
    assert sorted(map(sorted, again)) == sorted(map(sorted, bred[0]))


def test_packing_is_as_good_as_one_best_fit_of_all(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 256)
    rng = random.Random(4)
    for top, more in ((60, 0), (100, 1)):  # many short pieces; many over half a sequence, where groups cost one more
        lengths = [min(199, 1 + int(rng.expovariate(1 / top))) for _ in range(3000)]
        whole = len(packing.best_fit(sorted(range(3000), key=lambda i: -lengths[i]), lengths, 200))
        got = packing.pack(spark.createDataFrame([(i, x) for i, x in enumerate(lengths)], "doc_id long, length long"), 200)
        bins = {}
        for r in got.collect():
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert sum(n for b in bins.values() for _, n in b) == sum(lengths)
        assert all(sum(n for _, n in b) <= 200 for b in bins.values())
        assert len(bins) <= whole + more, (top, len(bins), whole)


def test_group_whose_standing_bins_are_full_is_not_bred():
    # 600 full bins of two, and five pieces that fit with nothing: best fit takes more bins than the tokens need.
    lengths = sorted([*range(700, 1300), *(2000 - x for x in range(700, 1300)), *[1001] * 5])
    assert len(packing.best_fit(sorted(range(1205), key=lambda i: -lengths[i]), lengths, 2000)) > -(-sum(lengths) // 2000)
    assert len(packing.evolve(lengths, [], 2000, "x", spare=1 / 8)) == 1  # these go to the next level
    assert len(packing.evolve(lengths, [], 2000, "x", generations=1)) > 1  # the last level is bred


def test_packing_of_many_tiny_pieces_and_of_pieces_that_never_fit_together(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 64)
    for length, n, best in ((1, 1500, 8), (120, 500, 500)):
        rows = spark.range(n).selectExpr("id AS doc_id", f"{length}L AS length")
        assert packing.pack(rows, 200).select("sequence_id").distinct().count() == best


def test_breeding_saves_sequences_that_the_seed_needs():
    """Bins cut into three pieces each, so a packing without room exists."""
    seeds, reached = [], []
    for k in range(10):
        rng = random.Random(k)
        lengths = []
        for _ in range(12):
            a = rng.randrange(300, 450)
            b = rng.randrange(250, min(400, 900 - a))
            lengths += [a, b, 1000 - a - b]
        seed = packing.best_fit(sorted(range(36), key=lambda i: -lengths[i]), lengths, 1000)
        bred = packing.evolve(lengths, [], 1000, str(k), generations=200)[0]
        assert sorted(i for b in bred for i in b) == list(range(36))
        assert all(sum(lengths[i] for i in b) <= 1000 for b in bred) and len(bred) <= len(seed)
        seeds.append(len(seed))
        reached.append(len(bred))
    assert min(seeds) == 13 and sum(n == 12 for n in reached) >= 2 and sum(reached) <= sum(seeds) - 5


def test_swaps_keep_every_piece_and_fill_bins():
    lengths = [60, 30, 50, 40, 35, 48, 7]
    bins = [[0, 1], [2, 3]]
    loose = packing.swapped(bins, {4, 5, 6}, lengths, 100)
    assert sorted(loose) == [1, 3, 6] and [sorted(b) for b in bins] == [[0, 4], [2, 5]]


# 3, 6
def test_token_counts_equal_the_library(spark):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for df in (small(spark), edge(spark)):
        text = {r["doc_id"]: r["text"] or "" for r in df.where("doc_id is not null").collect()}
        for r in token_count.token_counts(df, PIECES).collect():
            if r["doc_id"] is not None:
                t = text[r["doc_id"]]
                assert (r["n_bytes"], r["n_tokens"]) == (len(t.encode()), len(m.encode(t)))
                assert r["over_limit"] == (r["n_tokens"] > 4096)
    assert token_count.token_counts(edge(spark).limit(0), PIECES).count() == 0


def test_encoder_equals_the_library(spark, monkeypatch):
    enc = Encoder(BPE)
    monkeypatch.setattr("pairnet.llm.encoders.CACHE_PARTS", 50)  # generations turn over
    texts = [t or "" for t in EDGE_TEXTS] + [r["text"] for r in small(spark).limit(60).collect()]
    rng = np.random.default_rng(4)
    bits = ["a", "B", "\u00e9", "\n", "\t", " ", " ", "  ", ".", ",", "'s", "1", "word", "\u4e2d", "-", "\u00a0", "<|endoftext|>"]
    texts += ["".join(rng.choice(bits, rng.integers(0, 14))) for _ in range(3000)]
    for k in range(0, len(texts), 7):
        part = texts[k:k + 7]
        want = [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in enc.tok.encode_batch(part, add_special_tokens=False)]
        assert enc.encode(part) == want


def test_token_files_round_trip(spark, tmp_path, monkeypatch):
    import zstandard

    docs = small(spark)
    folder = f"file://{tmp_path}/ids"
    manifest = token_files.write_ids(docs, folder, BPE, 2, frame_ids=500, file_bytes=100_000)
    assert manifest.count() > 1
    enc, start = Encoder(BPE), 0
    want = {}
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        want[r["doc_id"]] = enc.encode([r["text"] or ""])[0] + struct.pack("<I", 2)
    assert {r["doc_id"]: bytes(r["ids"]) for r in token_files.read_ids(spark, folder).collect()} == want
    some = token_files.read_ids(spark, folder, [3, 77, 10 ** 9]).collect()
    assert {r["doc_id"]: bytes(r["ids"]) for r in some} == {k: want[k] for k in (3, 77)}
    whole = b"".join(zstandard.ZstdDecompressor().stream_reader(open(f, "rb"), read_across_frames=True).read()
                     for f in sorted((tmp_path / "ids").glob("part-*.tzst")))
    assert whole == b"".join(want[k] for k in sorted(want))
    for r in sorted(token_files.token_digest(docs, BPE).collect(), key=lambda r: r["doc_id"]):
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(want[r["doc_id"]]) // 4, zlib.crc32(want[r["doc_id"]]))
        start += r["n_tokens"]


def test_token_file_damage_is_found():
    import io

    out = io.BytesIO()
    w = token_files.SeekableWriter(out, 4)
    for k in range(5):
        w.add(k if k else None, struct.pack("<6I", *range(6)))
    w.finish()
    raw = bytearray(out.getvalue())
    assert token_files.SeekableReader(bytes(raw)).document(3) == struct.pack("<6I", *range(6))
    raw[len(raw) - 9 - 4] ^= 1  # the last frame's checksum
    with pytest.raises(ValueError):
        token_files.SeekableReader(bytes(raw)).document(4)


def test_token_files_edges(spark):
    rows = token_files.token_digest(edge(spark), BPE).collect()
    assert len(rows) == len(EDGE_TEXTS) + 4
    assert sorted(r["start"] for r in rows)[0] == 0
    assert token_files.token_digest(edge(spark).limit(0), BPE).count() == 0


# 4
@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda b: str(len(b) % 3)])
@pytest.mark.parametrize("batches", [1, 2, 3])
def test_exact_dedup(spark, digest, batches):
    df = edge(spark)
    norm = {}
    for r in df.collect():
        norm.setdefault((r["text"] or "").encode().lower(), []).append(r["doc_id"])
    got = exact_dedup.exact_groups(df, batches, digest=digest)
    want = sorted(((i, max((x for x in ids if x is not None), default=None), len(ids),
                    i == max((x for x in ids if x is not None), default=None))
                   for ids in norm.values() for i in ids), key=repr)
    assert rows_of(got, "doc_id", "keep_id", "group_size", "kept") == want
    if digest is exact_dedup.sha256:
        kept = exact_dedup.kept_documents(df, got)
        assert kept.columns == df.columns and kept.count() == len(norm)
    assert exact_dedup.exact_groups(df.limit(0), batches).count() == 0


def test_only_texts_of_repeated_digests_are_shuffled(spark, monkeypatch):
    texts = [f"text {k}" for k in range(3000)] + ["one of many"] * 40 + [None] * 3 + [""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    passed, screen = [], exact_dedup.screened

    def counted(*args):
        out = screen(*args)
        passed.append(out.count())
        return out

    monkeypatch.setattr(exact_dedup, "screened", counted)
    got = exact_dedup.exact_groups(df).collect()
    assert 44 <= passed[0] < 44 + 3000 / 50  # all that are repeated, and few of the others
    assert sorted(r["group_size"] for r in got) == [1] * 3000 + [4] * 4 + [40] * 40
    assert {r["keep_id"] for r in got if r["group_size"] > 1} == {3039, 3043}


def test_exact_groups_come_from_the_screen(spark, monkeypatch):
    """Repeats in a later batch join a group only by way of the filter."""
    df = spark.createDataFrame([(k, f"Text {k % 4}") for k in range(40)], "doc_id long, text string")
    sizes = [r["group_size"] for r in exact_dedup.exact_groups(df, 3).collect()]
    assert sizes == [10] * 40
    monkeypatch.setattr(exact_dedup.Snapshot, "screen", lambda self, groups: groups.where("false"))
    missed = [r["group_size"] for r in exact_dedup.exact_groups(df, 3).collect()]
    assert len(missed) == 40 and max(missed) < 10


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 30_000])
def test_binary_fuse(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    f = exact_dedup.BinaryFuse.from_bytes(exact_dedup.BinaryFuse.build(np.concatenate([keys, keys])).to_bytes())
    assert f.contains(keys).all()
    assert f.contains(rng.integers(0, 1 << 63, 50_000, dtype=np.uint64)).mean() < 0.001
    assert n < 30_000 or len(f.cells) < 1.25 * n


# 5
def test_nearest_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 64)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(300, 6)), np.ones((60, 6)) * 0.3])
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    rows += [(900, None, 1), (901, [0.0] * 6, 1), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (903, [float("nan")] * 6, 1),
             (904, [1.0], 1), (None, [1.0] * 6, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in ann.search(df, df.where("vec_id % 20 = 0"), 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 360, 20):
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(360), -np.round(s, 9))) if i != q][:5]
        assert [r for r, _, _ in sorted(got[q])] == [1, 2, 3, 4, 5]
        assert all(abs(s[i] - score) < 1e-9 for _, i, score in got[q])
        hits += len({i for _, i, _ in got[q]} & set(order))
    assert hits >= 0.95 * 5 * 18
    few = ann.search(df.where("vec_id < 3"), df.where("vec_id = 0"), 5)
    assert few.count() == 2
    assert ann.search(df.limit(0), df.limit(0), 5).count() == 0


def test_equal_products_keep_the_smaller_ids(spark):
    """Different vectors with the same products: ties at the cut by id."""
    rng = np.random.default_rng(5)
    rest = {tuple(v) for v in rng.integers(-3, 4, (900, 4)).tolist()}
    rows = [(0, [1.0, 0.0, 0.0, 0.0, 0.0])]
    rows += [(k + 1, [1.0, *map(float, v)]) for k, v in enumerate(rng.permutation(sorted(rest)).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, df.where("vec_id = 0"), 5).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(k, 1.0) for k in range(1, 6)]


def test_chi_square_quantile():
    assert abs(ann.chi_square_quantile(0.95, 8) - 15.507) < 0.01


# 7
def test_language_id(spark):
    docs = common.documents(spark, "/root/testdata/sf0.01")
    got = langid.predict(docs, langid.fit(docs)).alias("p").join(docs.alias("d"), "doc_id")
    held = got.where("held_out and lang is not null")
    assert held.where("lang_pred = lang").count() >= 0.97 * held.count()
    model = langid.fit(edge(spark).where("lang = 'en'"))
    rows = {r["doc_id"]: r for r in langid.predict(edge(spark), model).collect()}
    assert rows[0]["lang_pred"] == rows[1]["lang_pred"] == rows[10]["lang_pred"] == "und" and rows[0]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    kept = langid.with_language(edge(spark), model)
    assert kept.columns == edge(spark).columns
    assert kept.where("doc_id in (0, 1, 2, 10, 14)").count() == 0 and kept.where("doc_id = 5").count() == 3
    assert langid.predict(docs.limit(0), langid.fit(docs.limit(0))).count() == 0


def test_more_languages_than_bits_of_a_word(spark):
    """Every one of 70 languages is learned and told apart."""
    rng = random.Random(8)
    rows, words = [], {}
    for k in range(70):
        own = words[f"l{k:02}"] = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)]
        rows += [(100 * k + n, " ".join(rng.sample(own, 9)), f"l{k:02}") for n in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.languages == tuple(sorted(words))
    assert model.predict([" ".join(w) for _, w in sorted(words.items())])[0] == sorted(words)
    got = langid.predict(docs, model).join(docs, "doc_id")
    assert got.count() == 420 and got.where("lang_pred != lang").count() == 0


def test_language_stage_without_labels(spark):
    docs = edge(spark).withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.language_id(spark, docs, None)
    assert kept.columns == docs.columns
    want = [t for t in (r["text"] for r in docs.collect()) if t and any(c.isalpha() for c in t)]
    assert sorted(r["text"] for r in kept.collect()) == sorted(want) and want


def test_language_stage_reads_texts_in_place(spark):
    docs, model = edge(spark), langid.Filter((), np.zeros(langid.SLOTS, np.uint8), np.zeros(0))
    kept = langid.with_language(docs, model)
    assert "own text" not in kept._jdf.queryExecution().toString()
    other = langid.with_language(docs.withColumnRenamed("text", "Text"), model)
    assert other.columns == ["Text" if c == "text" else c for c in docs.columns] and other.count() == kept.count() > 0


def test_filter_false_positives_are_corrected():
    rng = np.random.default_rng(1)
    own = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    f = langid.Filter.build(("a", "b"), own, np.where(np.arange(20_000) % 2, 1, 2).astype(np.uint64))
    mask = None
    for slot in langid.probes(own):
        mask = f.masks[slot] if mask is None else mask & f.masks[slot]
    assert ((mask & np.where(np.arange(20_000) % 2, 1, 2)) != 0).all()
    assert (f.false_rate < 0.01).all()


# 8
def near(fps, radius):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def plain_fingerprint(text):
    import xxhash

    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_brute_force(spark):
    for df in (small(spark), edge(spark).where("doc_id is not null")):
        docs = sorted(((r["doc_id"], r["text"]) for r in df.distinct().collect()))
        fps = [plain_fingerprint(t) for _, t in docs]
        assert [simhash.fingerprint(t or "") for _, t in docs] == fps
        want = {(i, f"{f:016x}", docs[c][0]) for (i, _), f, c in zip(docs, fps, near(fps, 4))}
        got = simhash.near_groups(df)
        assert set(rows_of(got, "doc_id", "fingerprint", "component_id")) == want
        kept = simhash.representatives(df, got)
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in want})
    assert simhash.near_groups(edge(spark).limit(0)).count() == 0


def test_simhash_representatives_without_own_ids(spark):
    """Components without an id, or that share one, keep one row each."""
    a, b, c, d, e, f = (" ".join(f"{k}{n}" for n in range(40)) for k in "abcdef")
    rows = [(None, a), (None, b), (None, b), (None, c), (None, ""), (5, d), (5, e), (3, e), (6, f), (None, f)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.representatives(df, simhash.near_groups(df))
    want = [(None, a), (None, b), (None, c), (None, ""), (5, d), (3, e), (6, f)]
    assert rows_of(kept, "doc_id", "text") == sorted(want, key=repr)


@pytest.mark.parametrize("hot", [4096, 20])
def test_simhash_links_of_hot_buckets(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "SLICE", 10)
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) for b in base for _ in range(25)})
    signed = [simhash._signed(f) for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 4)
    root = {r["node"]: r["root"] for r in components(edges).collect()}
    got, want = {}, {}
    for f, s, c in zip(fps, signed, near(fps, 4)):
        got.setdefault(root.get(s, s), set()).add(f)
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_hub_are_split_among_tasks(spark):
    """Half of the edges at one node: right roots, and a join that adaptive
    execution can split (two plain shuffles of written tables)."""
    from pairnet.llm import components as star

    hub = spark.range(1, 2001).selectExpr("0L AS a", "id AS b")
    chain = spark.range(5000, 7000).selectExpr("id AS a", "id + 1 AS b")
    edges = hub.unionByName(chain)
    root = {r["node"]: r["root"] for r in components(edges).collect()}
    assert root == {**{k: 0 for k in range(1, 2001)}, **{k: 5000 for k in range(5001, 7001)}}
    low = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
           "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
           "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.enabled": "true"}
    old = {k: spark.conf.get(k, None) for k in low}
    try:
        for k, v in low.items():
            spark.conf.set(k, v)
        # A hub below all its neighbours for the large star, above them for the small one.
        for step, hub in ((star._large_star, 0), (star._small_star, 100_000)):
            done = step(common.checkpoint(spark.range(1, 40001).selectExpr(f"{hub}L AS a", "id AS b").repartition(8), "edges"))
            done.collect()
            assert "skew=true" in done._jdf.queryExecution().executedPlan().toString(), step.__name__
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_samples_are_the_smallest_hashes_also_of_hot_values(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 > 0, 'hot', concat('x', id % 7)) AS lang")
    got = rows_of(common.bounded_sample(rows, "lang", 40), "doc_id", "lang")
    ranked = rows.selectExpr("*", "xxhash64(doc_id) AS h").collect()
    want = []
    for lang in {r["lang"] for r in ranked}:
        want += [(r["doc_id"], lang) for r in sorted((r for r in ranked if r["lang"] == lang), key=lambda r: r["h"])[:40]]
    assert got == sorted(want, key=repr)
    best = [r["doc_id"] for r in sorted(ranked, key=lambda r: r["h"])[:50]]
    assert [r["doc_id"] for r in common.fewest(rows, "doc_id", 3000, 50).collect()] == best
    same = spark.range(3000).selectExpr("7L AS doc_id", "'hot' AS lang")  # one hash: below the limit are all or none
    assert common.bounded_sample(same, "lang", 40).count() == 40 == common.fewest(same, "doc_id", 3000, 40).count()
    assert common.bounded_sample(rows.limit(0), "lang", 40).count() == 0


def test_token_files_of_one_id_fill_several_files(spark, tmp_path):
    rows = [(None, f"text {k % 400}") for k in range(1200)] + [(None, "one text")] * 600 + [(k, "a") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    manifest = token_files.write_ids(docs, f"file://{tmp_path}/ids", BPE, 2, file_bytes=4000)
    files = [r["n_docs"] for r in manifest.collect()]
    assert sum(files) == 2000 and max(files) < 500 and len(files) > 6
    got = token_files.token_digest(docs, BPE).orderBy("start").collect()
    assert len(got) == 2000 and [r["doc_id"] for r in got[1800:]] == list(range(200))
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:])) and got[0]["start"] == 0


def test_masks_bring_every_pair_together():
    rng = random.Random(5)
    for blocks in range(5, 9):
        keys = simhash.masks(blocks, 4)
        for _ in range(300):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), 4):
                b ^= 1 << bit
            assert any(a & m == b & m for m in keys)


# 9
def test_mixing(spark):
    df = edge(spark)
    got = mixing.plan(df)
    again = mixing.plan(df)
    cols = ("doc_id", "source", "size", "source_size", "target", "copies", "taken")
    assert rows_of(got, *cols) == rows_of(again, *cols)
    rows = got.collect()
    assert len(rows) == df.count() and all(r["taken"] <= 2 * r["size"] for r in rows)
    goal = {r["source"]: (r["source_size"], r["target"]) for r in rows}
    total = sum(s for s, _ in goal.values())
    assert abs(sum(t for _, t in goal.values()) - 1.5 * total) < 1e-6
    assert all(t <= 2 * s + 1e-9 for s, t in goal.values())
    mix = mixing.mixed(df, got)
    assert mix.columns == df.columns and mix.count() == sum(r["copies"] for r in rows)
    assert mixing.plan(df.limit(0)).count() == 0


@pytest.mark.parametrize("key", sorted(oracle.oracle_queries()))
def test_oracle(spark, duck_small, key):
    _, problems = compare(spark, duck_small, key, queries.registry()[key], oracle.oracle_queries()[key], SF_SMALL)
    assert not problems, problems


# 10
def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = common.documents(spark, sf), common.table(spark, sf, "labels")
    model = toxicity.fit(docs, labels)
    got = toxicity.scores(docs, model).join(labels, "doc_id").where("held_out").collect()
    hit = [r for r in got if r["toxic"] == 1]
    clean = [r for r in got if r["toxic"] == 0]
    assert sum(r["predicted"] for r in hit) >= 0.8 * len(hit)
    assert sum(r["predicted"] for r in clean) <= 0.02 * len(clean)
    chars = toxicity.CharModel(model.tables)
    for written in ("1d10t", "st*pid", "stuuuupid", "i d i o t", "m0r0n", "tra$h", "l.o.s.e.r"):
        text = f"The and {written} of the thing."
        best, n = model.hits([text], chars, PieceCache())[0]
        assert model.score(best, n) >= 0.5, written
    assert "idiot" in toxicity.restore_text("you 1d10t", chars)
    best, n = model.hits(["Call +1 (389) 555 or a-b, 3rd!! the the*** and&&&"], chars, PieceCache())[0]
    assert model.score(best, n) < 0.5
    rows = toxicity.scores(edge(spark), model).collect()
    assert len(rows) == len(EDGE_TEXTS) + 4 and all(0 <= r["score"] <= 1 for r in rows)
    none = toxicity.fit(docs.limit(0), labels)
    assert toxicity.scores(edge(spark), none).where("predicted = 1").count() == 0


def char_model():
    words = "idiot loser moron trash stupid scum ass the this that these of to in a and for with from is it on was " \
            "are one time well said man who her there more some them"
    tables = {size: np.zeros(n, np.int64) for size, n in toxicity.TABLES.items()}
    toxicity.count_grams([words] * 50, tables)
    return toxicity.CharModel(tables)


@pytest.mark.parametrize("written, word", [
    ("idio7", "idiot"), ("mor0n", "moron"), ("a$$", "ass"), ("a$$.", "ass"), ("idio+", "idiot"), ("1d107", "idiot"),
    ("1d10t5", "idiot"), ("idio777", "idiot"), ("a s s", "ass"), ("i t", "it")])
def test_last_letters_are_decoded(written, word):
    chars = char_model()
    tokens = written.split()
    assert word in {w for t in [*tokens, *toxicity.spaced(tokens)] for w in toxicity.token_words(t, chars)}
    for clean in ("that***", "the!!", "of%%%", "with&&&"):
        assert toxicity.token_words(clean, chars)[0] == clean.rstrip("*!%&")
    lexicon = toxicity.Toxicity(chars.tables, {"idiot": 3.0, "ass": 3.0}, (-1.0, 1.0, 0.0))
    assert lexicon.hits([f"the {written} of"], chars, PieceCache())[0][1] == (word in ("idiot", "ass"))


@pytest.mark.parametrize("written, word", [
    ("lo*er", "loser"), ("i*iot", "idiot"), ("mo*on", "moron"), ("s*um", "scum"), ("id*ot", "idiot"), ("*diot", "idiot"),
    ("#oron", "moron"), ("tras#", "trash"), ("scu*", "scum"), ("s%%m", "scum"), ("tr@*h", "trash")])
def test_masks_stand_for_any_letter(written, word):
    assert word in toxicity.token_words(written, char_model())


def test_one_slot_equals_many():
    for gram in ("ab", "\0a", "ßé", "abc", "b\0", "日本語", "stup", "\0öx\0"):
        codes = [np.array([0 if c == "\0" else ord(c)]) for c in gram]
        assert toxicity._slot(gram) == toxicity._slots(codes, len(gram))[0]


def all_paths(token, model):
    """Every word of the lattice with its best log probability, place by place."""
    paths = {("", "\0"): 0.0}
    runs = [len(m.group()) for m in toxicity.re.finditer(r"(.)\1*", token) for _ in m.group()]
    for c, run in zip(token, runs):
        once, again = toxicity.REPEAT[run > 2]
        emit = [(c, 0.0)] if c.isalpha() else \
            [(x, toxicity.LOOK - np.log(len(toxicity.LOOKS[c]))) for x in toxicity.LOOKS.get(c, "")]
        emit += [(x, toxicity.MASK) for x in model.alphabet] if c in toxicity.MASKS else []
        step = {}
        for (word, context), score in paths.items():
            to = [] if c.isalpha() else [(word, context, score + toxicity.DROP_SYMBOL)]
            for x, own in emit:
                same = x == context[-1]
                to += [(word, context, score + own + once)] * same
                to.append((word + x, (context + x)[-3:],
                           score + own + again * same + model.logp(context, x)))
            for w, k, v in to:
                step[w, k] = max(v, step.get((w, k), -np.inf))
        paths = step
    return {w: v + model.logp(k, "\0") for (w, k), v in paths.items()}


@pytest.mark.parametrize("token", ["s***m", "***", "t*#%h", "i#1*7", "1d10t5", "a$$!!", "l00o*er", "**iot", "stuuupid", "*1*|t", "m*%*n", "hello*", "loss$", "idiott1"])
def test_the_path_is_the_best_of_all(token):
    chars = char_model()
    paths = all_paths(token, chars)
    assert abs(paths[toxicity.restore(token, chars)] - max(paths.values())) < 1e-9


@pytest.mark.parametrize("token", ["1diot*oron", "l0ser*rash", "t0ash*um", "scu*stup1d", "mm0ronthis*s", "*hat0there*"])
def test_cuts_behind_three_letters_change_no_path(token):
    chars = char_model()
    paths = all_paths(token, chars)
    assert len(list(toxicity.parts(token))) > 1
    assert abs(paths[toxicity.restore(token, chars)] - max(paths.values())) < 1e-9


@pytest.mark.parametrize("alphabet", [0, 5000])
def test_long_tokens_take_bounded_time(alphabet):
    draw = random.Random(5)
    tokens = ["a1*0" * 2500, "a" + "*#%" * 3333, "a" + "".join(draw.choices("*#%013457@$!|", k=9999)),
              "".join(draw.choices("abcdestio*#013457@", k=10_000))]
    tables = char_model().tables
    tables[1][0x4E00:0x4E00 + alphabet] += 3
    for token in tokens:
        warm, at = toxicity.CharModel(tables), time.time()
        word = toxicity.restore(token, warm)
        assert time.time() - at < 20  # far under it; without a bound it does not end
        assert word and word == toxicity.restore(token, warm)
        toxicity.restore(token[7:], warm)  # what is kept from other tokens decides nothing
        toxicity.restore(token[:60], warm)
        assert word == toxicity.restore(token, warm) == toxicity.restore(token, toxicity.CharModel(tables))


def test_paths_that_a_beam_would_lose():
    """Only the last letters tell that the first are not those of common words."""
    tables = {size: np.zeros(n, np.int64) for size, n in toxicity.TABLES.items()}
    common = " ".join(a + b + c for a in "bcdfghkl" for b in "aeiou" for c in "mnprst")
    toxicity.count_grams([(common + " ") * 60 + "xan wan jan qan " * 3000 + "xqa " * 60 + "xqjwvq " * 10], tables)
    chars = toxicity.CharModel(tables)
    paths = all_paths("***wvq", chars)
    best = max(paths, key=paths.get)
    assert best == "xqjwvq" and toxicity.restore("***wvq", chars) == best


# pipeline and registration
def test_pipeline_stages(spark):
    docs = common.documents(spark, SF_SMALL)
    cols = docs.columns
    lang = corpus_pipeline.language_id(spark, docs, SF_SMALL)
    assert lang.columns == cols and lang.count() == docs.where(F.col("text").rlike(r"\p{L}")).count()
    kept = corpus_pipeline.exact(spark, lang, SF_SMALL)
    norm = {}
    for r in lang.collect():
        norm.setdefault(r["text"].encode().lower(), []).append(r["doc_id"])
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(map(max, norm.values()))
    alone = corpus_pipeline.near(spark, kept, SF_SMALL)
    by = sorted((r["doc_id"], r["text"]) for r in kept.collect())
    own = near([plain_fingerprint(t) for _, t in by], 4)
    assert sorted(r["doc_id"] for r in alone.collect()) == sorted({by[c][0] for c in own})
    mix = corpus_pipeline.mix(spark, alone, SF_SMALL)
    assert mix.columns == cols
    packed = corpus_pipeline.pack(spark, mix, SF_SMALL)
    assert packed.where("piece = 0").count() == mix.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language ID", "exact dedup", "SimHash near-dedup", "mixing", "packing"]


def test_pipeline_stages_give_python_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 6000, 1, 1).select(F.repeat(F.lit("many words "), 500).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    spark.conf.unset(key)
    try:
        corpus_pipeline.language_id(spark, edge(spark).withColumn("lang", F.lit(None).cast("string")), None)
        got = docs.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r["n"] for r in got) == 6000 and max(r["size"] for r in got) < 6 << 20
        spark.conf.set(key, "1m")  # a size of the user's own stays
        common.small_batches(spark)
        assert spark.conf.get(key) in ("1m", "1048576b", "1048576")
    finally:
        spark.conf.unset(key)


def test_packing_leaves_no_parts_in_its_workers(spark, tmp_path):
    path = shutil.copy(BPE, tmp_path / "own.json")  # an encoder that no other test has loaded
    packing.cut(small(spark), str(path)).collect()

    def held(batches):
        from pairnet.llm.encoders import _ENCODERS

        n = sum(b.num_rows for b in batches)
        e = _ENCODERS.get((str(path), True))
        kept = -1 if e is None else sum(len(x.place) for x in (e.rest, e.heads, e.tails))
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([kept])], ["n", "kept"])

    kept = {r["kept"] for r in spark.range(0, 64, 1, 8).mapInArrow(held, "n long, kept long").collect()}
    assert max(kept) == 0, kept


def test_registered():
    names = set(E.queries())
    assert {f"op{n}_" for n in range(1, 14)} <= {x.split("_")[0] + "_" for x in names} and "pipeline" in names
    assert E.queries()["pipeline"] is corpus_pipeline.run
