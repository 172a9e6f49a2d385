"""Nearest neighbours by stable projections, a kd-tree over them and a chi-square stopping test."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, table

PROJECTED = 8
NEAREST = 5
#: The search of a tree ends once a nearer neighbour would, with this probability, have been met.
CONFIDENCE = 0.97
LEAF = 64
#: Vectors of one tree, and the queries that meet it in one task.
TREE_ROWS, QUERY_ROWS = 16_384, 4_096
#: The only sample: projections from which the planes between cells are fitted, and the most cells (of one
#: length of vectors).  Every vector is in a cell; a cell of more than TREE_ROWS is held in several trees.
SAMPLE, CELLS = 65_536, 4_096
#: Rows (about) of which one task picks the least ids of equal vectors.
ALIKE_ROWS = 500_000
EVERY = 50


def chi_square_quantile(p: float, m: int) -> float:
    """By bisection of the closed form for even m."""
    def cdf(x):
        term, total = 1.0, 0.0
        for i in range(m // 2):
            total += term
            term *= x / 2 / (i + 1)
        return 1 - math.exp(-x / 2) * total

    lo, hi = 0.0, 50.0 * m
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


class KdTree:
    """Leaves of LEAF rows at most, with the boxes of their rows."""

    def __init__(self, x: np.ndarray):
        self.leaves = self._split(x, np.arange(len(x)))
        self.low = np.array([x[i].min(0) for i in self.leaves])
        self.high = np.array([x[i].max(0) for i in self.leaves])

    def _split(self, x: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
        done, open_ = [], [rows]
        while open_:
            r = open_.pop()
            if len(r) <= LEAF:
                done.append(r)
                continue
            axis = int(np.argmax(np.ptp(x[r], axis=0)))
            half = len(r) // 2
            order = r[np.argpartition(x[r, axis], half)]
            open_ += [order[:half], order[half:]]
        return done

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Squared distance from q to each leaf's box."""
        gap = np.maximum(self.low - q, 0) + np.maximum(q - self.high, 0)
        return (gap * gap).sum(1)


class Cells:
    """Space cut by planes at the medians of a sample into ``count`` boxes of as many rows each (about)."""

    def __init__(self, sample: np.ndarray, count: int):
        self.nodes: list[tuple[int, float, int, int]] = []  # axis (or -1), place, and next nodes (or the cell)
        self.low, self.high = [], []
        far = np.full(PROJECTED, np.inf)
        self._grow(sample, max(1, min(count, CELLS, len(sample))), -far, far)
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _grow(self, x: np.ndarray, count: int, low: np.ndarray, high: np.ndarray) -> int:
        at = len(self.nodes)
        self.nodes.append((-1, 0.0, len(self.low), 0))
        axis = int(np.argmax(np.ptp(x, axis=0))) if len(x) else 0
        if count > 1 and np.ptp(x[:, axis]) > 0:
            left = count // 2
            values = np.sort(x[:, axis])
            cut = float(values[min(len(x) - 2, len(x) * left // count)])
            cut = cut if cut < values[-1] else float(values[values < values[-1]][-1])
            side, upto, above = x[:, axis] <= cut, high.copy(), low.copy()
            upto[axis] = above[axis] = cut
            self.nodes[at] = (axis, cut, self._grow(x[side], left, low, upto), self._grow(x[~side], count - left, above, high))
        else:
            self.low.append(low)
            self.high.append(high)
        return at

    def of(self, p: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        out, open_ = np.zeros(len(p), np.int32), [(0, np.arange(len(p)))]
        while open_:
            k, rows = open_.pop()
            axis, cut, left, right = self.nodes[k]
            if axis < 0:
                out[rows] = left
            elif len(rows):
                side = p[rows, axis] <= cut
                open_ += [(left, rows[side]), (right, rows[~side])]
        return out

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Squared distance from q to each cell."""
        gap = np.maximum(self.low - q, 0) + np.maximum(q - self.high, 0)
        return (gap * gap).sum(1)


def projection(dims: int) -> np.ndarray:
    return np.random.default_rng(20 + dims).standard_normal((dims, PROJECTED))


def projected(v: np.ndarray) -> np.ndarray:
    return (v / np.linalg.norm(v, axis=1, keepdims=True)) @ projection(v.shape[1])


def search(tree: KdTree, unit: np.ndarray, lone: np.ndarray, q: np.ndarray, qp: np.ndarray, own: int, kth: float, limit: float) -> np.ndarray:
    """The nearest found: leaves in order of projected distance, verified on the whole vectors.

    A vector at distance d lies within d * sqrt(limit) in the projection with CONFIDENCE; once the
    next leaf is farther than that for the NEAREST-th distance found (or ``kth``, known before), the
    search ends.  ``lone`` is the id of a vector that only one row has, else -1.
    """
    bound = tree.bounds(qp)
    order = np.argsort(bound, kind="stable")
    best, at = [], 0
    while at < len(order) and bound[order[at]] <= kth * limit:
        take = order[at : at + 8]
        take = take[bound[take] <= kth * limit]
        at += len(take)
        rows = np.concatenate([tree.leaves[k] for k in take])
        cos = unit[rows] @ q
        ok = (lone[rows] != own) & (1e-9 >= (2 - 2 * cos) - kth)
        best += zip((-cos[ok]).tolist(), rows[ok].tolist())
        best.sort()
        if len(best) > 4 * NEAREST:
            kept = best[NEAREST - 1][0] + 1e-9
            best = [b for b in best if b[0] <= kept]
        if len(best) >= NEAREST:
            kth = min(kth, max(2 + 2 * best[NEAREST - 1][0], 0.0))
    return np.array([b[1] for b in best], np.int64)


def exact(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines in double precision, components summed one after another, so that other engines get the same bits."""
    last = lambda x: np.cumsum(x, axis=-1)[..., -1]
    return last(v * q) / (np.sqrt(last(v * v)) * np.sqrt(last(q * q)))


_OUT = "query_id long, h long, vec_id long, score double"


def _task(rows: pd.DataFrame) -> pd.DataFrame:
    """Candidates (ids null for queries) and queries of one tree -> at most NEAREST candidates of each query."""
    c, q = rows[rows.query_id.isna()], rows[rows.query_id.notna()]
    out: tuple[list, list, list, list] = ([], [], [], [])
    if len(c) and len(q):
        v, qs = np.stack(c.v.to_numpy()), np.stack(q.v.to_numpy())
        ids = [np.sort(i) for i in c.ids]
        lone = np.array([i[0] if len(i) == 1 else -1 for i in ids], np.int64)
        unit, qu = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (v, qs))
        r = projection(v.shape[1])
        tree, limit, qp = KdTree(unit @ r), chi_square_quantile(CONFIDENCE, PROJECTED), qu @ r
        for i, (own, h, kth) in enumerate(zip(q.query_id.to_numpy(np.int64), q.h.to_numpy(np.int64), q.kth.to_numpy())):
            near = search(tree, unit, lone, qu[i], qp[i], own, kth, limit)
            if not len(near):
                continue
            n = np.array([len(ids[j]) for j in near])
            vec, score = np.concatenate([ids[j] for j in near]), np.repeat(exact(v[near], qs[i]), n)
            vec, score = vec[vec != own], score[vec != own]
            top = np.lexsort((vec, -score))[:NEAREST]
            for o, x in zip(out, (np.full(len(top), own), np.full(len(top), h), vec[top], score[top])):
                o.append(x)
    names = ["query_id", "h", "vec_id", "score"]
    return pd.DataFrame({c: np.concatenate(o) if o else np.empty(0, np.float64 if c == "score" else np.int64) for c, o in zip(names, out)})


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): without null, zero, or not wholly finite vectors."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null").where(fine)


def distinct_vectors(rows: DataFrame, n: int) -> DataFrame:
    """(v, ids): each vector once, with the NEAREST + 1 least ids that have it, which are all that a ranking
    with ties to the smaller id can need.  The rows of a vector that many have are split before."""
    least = lambda c: F.slice(F.array_sort(c), 1, NEAREST + 1)
    part = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, math.ceil(n / ALIKE_ROWS))))
    some = rows.groupBy("v", part.alias("part")).agg(least(F.collect_set("vec_id")).alias("ids"))
    return some.groupBy("v").agg(least(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))


def _project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (n, v, and others) with the projection of v at the end."""
    for b in batches:
        n, out = b.column(0).to_numpy(), np.zeros((b.num_rows, PROJECTED))
        flat, off = b.column(1).flatten().to_numpy(), np.concatenate([[0], np.cumsum(n)])
        for dims in np.unique(n):
            mine = np.flatnonzero(n == dims)
            out[mine] = projected(flat[off[mine][:, None] + np.arange(dims)])
        p = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), PROJECTED).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([*b.columns, p], [*b.schema.names, "p"])


def _with_cells(cells: dict[int, Cells], near: bool):
    """Adds the ``cell`` of each row by its projection; with ``near`` a row for each cell besides that one
    which may hold a vector nearer than the row's ``kth``."""
    limit = chi_square_quantile(CONFIDENCE, PROJECTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, p = b.column(0).to_numpy(), b.column(b.schema.get_field_index("p")).flatten().to_numpy().reshape(-1, PROJECTED)
            home = np.zeros(len(n), np.int32)
            for dims in np.unique(n):
                home[n == dims] = cells[dims].of(p[n == dims])
            if not near:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home)], [*b.schema.names, "cell"])
                continue
            kth = b.column(b.schema.get_field_index("kth")).to_numpy()
            for at in range(0, len(n), 256):  # so that a batch of queries with many cells stays small
                row, cell = [], []
                for i in range(at, min(at + 256, len(n))):
                    hit = np.flatnonzero(cells[n[i]].bounds(p[i]) <= kth[i] * limit)
                    hit = hit[hit != home[i]]
                    row.append(np.full(len(hit), i))
                    cell.append(hit.astype(np.int32))
                yield pa.RecordBatch.from_arrays([*b.take(pa.array(np.concatenate(row))).columns, pa.array(np.concatenate(cell))], [*b.schema.names, "cell"])

    return run


def nearest(vectors: DataFrame, scratch: Scratch) -> DataFrame:
    """Each query's NEAREST found: query_id, rank, vec_id, score.

    Every vector lies in one cell of the projected space.  A query is searched in its own cell, then in
    those others which the stopping test does not rule out for the distance found there.  A task is a
    tree over TREE_ROWS vectors of a cell (about) with QUERY_ROWS of its queries.  Vectors of another
    length than the query's are no candidates, nor are rows that share its vec_id; null, zero and not
    finite ones take no part.  Rows that repeat a vec_id and vector count as one; a vec_id with several
    vectors counts with the nearest, as a query too.  Ties go to the smaller vec_id.  Without queries, or of
    an empty table, there is nothing; other columns, whatever their names, are not looked at.
    """
    rows = scratch.keep(usable(vectors), "vectors")
    base = distinct_vectors(rows, rows.count()).select(F.size("v").alias("n"), "v", "ids")
    base = scratch.keep(base.mapInArrow(_project, "n int, v array<double>, ids array<long>, p array<double>"), "projected")
    many = dict(map(tuple, base.groupBy("n").count().collect()))  # one row for each length
    sample = base.select("n", "p").orderBy(F.xxhash64("p")).limit(SAMPLE).collect()
    cells = {n: Cells(np.array([r.p for r in sample if r.n == n]).reshape(-1, PROJECTED), math.ceil(c / TREE_ROWS)) for n, c in many.items()}
    held = base.mapInArrow(_with_cells(cells, False), "n int, v array<double>, ids array<long>, p array<double>, cell int").drop("p")
    held = scratch.keep(held, "cells")
    trees = scratch.keep(held.groupBy("n", "cell").agg(F.ceil(F.count(F.lit(1)) / TREE_ROWS).cast("int").alias("trees")), "trees")

    queries = rows.where(F.col("vec_id") % EVERY == 0).distinct().select(F.size("v").alias("n"), "v", F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("h"))
    columns = "n int, v array<double>, query_id long, h long, p array<double>"
    queries = scratch.keep(queries.mapInArrow(_project, columns), "queries")
    home = queries.mapInArrow(_with_cells(cells, False), f"{columns}, cell int").withColumn("kth", F.lit(float("inf")))
    first = scratch.keep(_searched(held, trees, home, scratch), "first")
    kth = first.groupBy("query_id", "h").agg(_top(F.struct((-F.col("score")).alias("s"), "vec_id")).alias("top"))
    kth = kth.select("query_id", "h", F.when(F.size("top") == NEAREST, 2 + 2 * F.element_at("top", NEAREST)["s"]).alias("kth"))
    known = queries.join(kth, ["query_id", "h"], "left").select("n", "v", "query_id", "h", "p", F.greatest(F.coalesce("kth", F.lit(float("inf"))), F.lit(0.0)).alias("kth"))
    rest = known.mapInArrow(_with_cells(cells, True), f"{columns}, kth double, cell int")
    found = first.unionAll(_searched(held, trees, rest, scratch)) if any(len(c.low) > 1 for c in cells.values()) else first
    one = found.groupBy("query_id", "vec_id").agg((-F.max("score")).alias("s"))
    top = one.groupBy("query_id").agg(_top(F.struct("s", "vec_id")).alias("top"))
    return top.select("query_id", F.posexplode("top").alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def _top(x):
    """Of a query's few found in each tree the NEAREST first ones."""
    return F.slice(F.array_sort(F.collect_list(x)), 1, NEAREST)


def _searched(held: DataFrame, trees: DataFrame, queries: DataFrame, scratch: Scratch) -> DataFrame:
    """What the queries (with ``cell`` and ``kth``) find in their cells' trees."""
    asked = scratch.keep(queries.drop("p"), "asked")
    blocks = asked.groupBy("n", "cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("blocks")).join(trees, ["n", "cell"])
    spread = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    dealt = lambda key, name: F.pmod(F.xxhash64(*key), F.col(name)).cast("int")
    none = lambda kind: F.lit(None).cast(kind)
    c = held.join(blocks, ["n", "cell"]).withColumn("tree", dealt(["v"], "trees")).withColumn("block", spread("blocks"))
    q = asked.join(blocks, ["n", "cell"]).withColumn("block", dealt(["query_id", "h"], "blocks")).withColumn("tree", spread("trees"))
    c = c.select("n", "cell", "tree", "block", "v", "ids", none("long").alias("query_id"), none("long").alias("h"), none("double").alias("kth"))
    q = q.select("n", "cell", "tree", "block", "v", none("array<long>").alias("ids"), "query_id", "h", "kth")
    return c.unionAll(q).groupBy("n", "cell", "tree", "block").applyInPandas(_task, _OUT)


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), Scratch(spark, "nearest"))
