"""Operator 5: nearest neighbours by low-dimensional stable projections.

Largest inner product is turned into smallest Euclidean distance by one more
coordinate (the root of M^2 - |x|^2, M the largest norm; 0 for a query). A
fixed Gaussian (2-stable) matrix projects to ``PROJECTED`` dimensions, and a
kd-tree indexes the projections: its top, fitted on a bounded sample, deals
all vectors into cells, and each cell holds the rest of the tree.

A query walks a cell's leaves by increasing projected distance and verifies
their vectors with the real inner products. The squared projected distance of
a vector over its squared real distance is chi-square distributed, so the walk
ends once a vector nearer than the k-th found would have a projection that far
away with probability under 1 - ``CONFIDENCE``. Cells are visited in rounds
by increasing projected distance: the nearest first, then ``WIDER`` times as
many as before, without those that the test excludes by the bound so far.

Equal vectors are one entry with their smallest ids. Every vector is indexed;
only the cells' borders come from the sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairnet.llm.common import fewest, parts_for, quoted
from pairnet.session import checkpoint

PROJECTED = 8
CONFIDENCE = 0.97
SEED = 20240611
#: Vectors a cell and its parts hold, most cells (so their boxes stay small),
#: vectors of a leaf, sampled projections for the cells' borders, queries that
#: visit a cell together, cells of a round to those of all before.
CELL, PART, MOST_CELLS, LEAF, SAMPLE, VISITORS, WIDER = 1024, 1 << 16, 4096, 32, 1 << 16, 4096, 4


def chi_square_quantile(p: float, freedom: int) -> float:
    """Inverse chi-square distribution for an even number of degrees."""
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        x = (lo + hi) / 2
        below = 1 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(freedom // 2))
        lo, hi = (x, hi) if below < p else (lo, x)
    return hi


def projection(dims: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dims + 1, PROJECTED))


def projected(x: np.ndarray, largest: float | None) -> np.ndarray:
    """Projections of vectors (``largest``: M) or of queries (None)."""
    more = np.zeros(len(x)) if largest is None else np.sqrt(np.maximum(0, largest ** 2 - (x * x).sum(1)))
    return np.column_stack([x, more]) @ projection(x.shape[1])


def splits(points: np.ndarray, cells: int) -> list[tuple[int, float]]:
    """A kd-tree's inner nodes in heap order (dimension, border)."""
    nodes: list[tuple[int, float]] = [(0, 0.0)] * (cells - 1)
    held = {0: points}
    for k in range(cells - 1):
        own = held.pop(k)
        if len(own):
            dim = int(np.argmax(own.max(0) - own.min(0)))
            border = float(np.median(own[:, dim]))
        else:
            dim, border = 0, 0.0
        nodes[k] = (dim, border)
        left = own[:, dim] <= border if len(own) else np.zeros(0, bool)
        held[2 * k + 1], held[2 * k + 2] = own[left], own[~left]
    return nodes


def cell_of(points: np.ndarray, nodes: list[tuple[int, float]]) -> np.ndarray:
    at = np.zeros(len(points), np.int64)
    dims, borders = np.array([d for d, _ in nodes], np.int64), np.array([b for _, b in nodes])
    for _ in range(int(math.log2(len(nodes) + 1))):
        at = 2 * at + 1 + (points[np.arange(len(points)), dims[at]] > borders[at])
    return at - len(nodes)


@dataclass
class Tree:
    """A cell's kd-tree down to leaves: point order, leaf bounds, leaf boxes."""

    order: np.ndarray
    edges: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def build(cls, points: np.ndarray) -> Tree:
        leaves, todo = [], [np.arange(len(points))]
        while todo:
            own = todo.pop()
            if len(own) <= LEAF:
                leaves.append(own)
                continue
            span = points[own]
            dim = int(np.argmax(span.max(0) - span.min(0)))
            own = own[np.argpartition(span[:, dim], len(own) // 2)]
            todo += [own[:len(own) // 2], own[len(own) // 2:]]
        return cls(np.concatenate(leaves), np.cumsum([0] + [len(x) for x in leaves]),
                   np.stack([points[x].min(0) for x in leaves]), np.stack([points[x].max(0) for x in leaves]))


def box_distance(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of a point to boxes."""
    off = np.maximum(0, np.maximum(low - q, q - high))
    return (off * off).sum(-1)


def search_cell(tree: Tree, vectors: np.ndarray, q: np.ndarray, pq: np.ndarray, k: int, bound: float,
                far: float, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions and inner products of the cell's ``k`` best for one query,
    none below ``bound``; of equal products the first in ``vectors``.

    ``bound``: the k-th best inner product known (-inf: none); ``far``: M^2 +
    |q|^2, so that far - 2 * product is a squared distance; ``factor``: the
    chi-square quantile."""
    lead = box_distance(pq, tree.low, tree.high)
    order = np.argsort(lead, kind="stable")
    lead = lead[order]
    at, step = 0, 4
    found, scores = np.zeros(0, np.int64), np.zeros(0)
    while at < len(order):
        if np.isfinite(bound) and lead[at] > factor * max(0.0, far - 2 * bound):
            break  # the chi-square test holds for all that is left
        pick = np.concatenate([tree.order[tree.edges[i]:tree.edges[i + 1]] for i in order[at:at + step]])
        scores = np.concatenate([scores, vectors[pick] @ q])
        found = np.concatenate([found, pick])
        if len(found) > k:
            last = np.partition(scores, len(scores) - k)[len(scores) - k]
            best, ties = np.flatnonzero(scores > last), np.flatnonzero(scores == last)
            best = np.concatenate([best, ties[np.argsort(found[ties])[:k - len(best)]]])
            found, scores = found[best], scores[best]
        if len(found) >= k:
            bound = max(bound, float(scores.min()))
        at, step = at + step, min(64, step * 2)
    fine = scores >= bound
    return found[fine], scores[fine]


def search(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: each query's ``k``
    largest inner products among all other rows, ties to the smaller id.

    Vectors that are null, all zero, or hold a null or non-finite component
    take no part, nor do rows without an id or of another length than the most
    common one. Rows that share an id are candidates each; of such queries the
    smallest vector asks, and a query leaves out its own id. An empty table gives an empty result; fewer than ``k``
    candidates are all returned. Other columns are ignored."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def usable(df: DataFrame) -> DataFrame:
        v = F.col("v")
        rows = df.select(quoted(id_col).cast("long").alias("id"), quoted(vector_col).cast("array<double>").alias("v"))
        fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return rows.where(F.col("id").isNotNull() & v.isNotNull() & fine & F.exists("v", lambda x: x != 0))

    base = usable(vectors)
    common = base.groupBy(F.size("v").alias("dims")).count().orderBy(F.col("count").desc(), "dims").first()
    if common is None:
        return empty
    dims = int(common["dims"])
    base = base.where(F.size("v") == dims)
    # Equal vectors: one entry with the k + 1 smallest ids (a partial top-k a task).
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    entries = base.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("v").agg(
        F.sort_array(F.collect_list("id")).alias("ids"))
    entries = checkpoint(entries.select(F.col("ids")[0].alias("rep"), "ids", "v"), "vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    r = entries.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("largest")).first()
    n, largest = int(r["n"]), float(r["largest"])
    asked = checkpoint(usable(queries).where(F.size("v") == dims).groupBy("id").agg(F.min("v").alias("v")), "queries")

    # The tree's top, from a bounded sample of projections.
    cells = 1 << max(0, min(MOST_CELLS, -(-n // CELL)).bit_length() - 1)
    sample = fewest(entries.select("rep", "v"), "rep", n, min(SAMPLE, 32 * cells)).select("v").toPandas()
    nodes = splits(projected(np.stack(sample["v"]), largest), cells)
    parts = parts_for(n, cells * PART)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            p = projected(np.stack(f["v"]), largest)
            yield pd.DataFrame({"cell": cell_of(p, nodes) if nodes else np.zeros(len(f), np.int64),
                                "rep": f["rep"], "v": f["v"], "p": list(p)})

    placed = entries.select("rep", "v").mapInPandas(place, "cell long, rep long, v array<double>, p array<double>") \
        .withColumn("part", F.pmod(F.xxhash64("rep"), F.lit(parts)))
    placed = checkpoint(placed, "cells")
    # One box per cell, at most MOST_CELLS.
    boxes = placed.groupBy("cell").agg(
        F.array(*[F.min(F.col("p")[i]) for i in range(PROJECTED)]).alias("low"),
        F.array(*[F.max(F.col("p")[i]) for i in range(PROJECTED)]).alias("high")).orderBy("cell").toPandas()
    names, low, high = boxes["cell"].to_numpy(), np.stack(boxes["low"]), np.stack(boxes["high"])
    factor = chi_square_quantile(CONFIDENCE, PROJECTED)

    def route(first: int, end: int):
        """Queries (id, v, bound) to the cells that are ``first`` to ``end`` in
        their order of projected distance, but for those that the chi-square
        test excludes."""
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for lo in range(0, len(f), 1000):
                    g = f[lo:lo + 1000]
                    x, bound = np.stack(g["v"]), g["bound"].to_numpy()
                    p, far = projected(x, None), largest ** 2 + (x * x).sum(1)
                    d = np.stack([box_distance(q, low, high) for q in p])
                    near = np.argsort(d, axis=1, kind="stable")[:, first:end]
                    reach = np.where(np.isneginf(bound), np.inf, factor * np.maximum(0, far - 2 * bound))
                    at, nth = np.nonzero(np.take_along_axis(d, near, 1) <= reach[:, None])
                    yield pd.DataFrame({"cell": names[near[at, nth]], "id": g["id"].to_numpy()[at], "bound": bound[at]})
        return run

    def visit(routed: DataFrame) -> DataFrame:
        # At most MOST_CELLS rows: how many slices of visitors a cell gets.
        load = checkpoint(routed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / VISITORS).cast("int").alias("slices")))
        slice_ = F.pmod(F.xxhash64("id"), F.col("slices")).cast("int")
        visitors = routed.join(F.broadcast(load.toDF("cell", "slices")), "cell").withColumn("slice", slice_).join(asked.select("id", "v"), "id") \
            .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        visitors = visitors.select("cell", "part", "slice", "id", "bound", "v")
        held = placed.join(F.broadcast(load), "cell").select(
            "cell", "part", "rep", "v", "p", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
        held = held.toDF(*held.columns)

        def run(own: pd.DataFrame, guests: pd.DataFrame) -> pd.DataFrame:
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            if len(own) and len(guests):
                own = own.sort_values("rep")
                x, rep = np.stack(own["v"]), own["rep"].to_numpy()
                tree, q = Tree.build(np.stack(own["p"])), np.stack(guests["v"])
                p, far = projected(q, None), largest ** 2 + (q * q).sum(1)
                for i, (name, bound) in enumerate(zip(guests["id"], guests["bound"])):
                    at, s = search_cell(tree, x, q[i], p[i], k + 1, bound, far[i], factor)
                    out.append((np.full(len(at), name), rep[at], s))
            cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0)] * 3
            return pd.DataFrame({"id": cols[0], "rep": cols[1], "score": cols[2]})

        keys = ["cell", "part", "slice"]
        return held.groupBy(*keys).cogroup(visitors.groupBy(*keys)).applyInPandas(run, "id long, rep long, score double")

    best = Window.partitionBy("id").orderBy(F.col("score").desc(), "rep")

    def kept(found: DataFrame) -> DataFrame:
        return found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)

    # Rounds over ever more cells: each one's bounds keep the next from
    # returning what can't be among the nearest, so a query's rows grow with
    # the number of rounds, not of cells.
    top, first, end = spark.createDataFrame([], "id long, rep long, score double"), 0, 1
    while first < len(names):
        bound = top.groupBy("id").agg(F.min("score").alias("b"), F.count(F.lit(1)).alias("n")) \
            .select("id", F.when(F.col("n") > k, F.col("b")).alias("bound"))
        known = asked.join(bound, "id", "left").select("id", "v", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"))
        routed = checkpoint(known.mapInPandas(route(first, end), "cell long, id long, bound double"), "visits")
        if routed.isEmpty():
            break  # all that is left is farther
        top = checkpoint(kept(top.unionByName(visit(routed))).select("id", "rep", "score"), "top")
        first, end = end, end * WIDER
    ids = entries.select("rep", F.explode("ids").alias("vec_id"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.col("score").desc(), "vec_id"))
    return top.join(ids, "rep").where(F.col("vec_id") != F.col("id")).withColumn("rank", rank) \
        .where(F.col("rank") <= k).select(F.col("id").alias("query_id"), "rank", "vec_id", "score")
