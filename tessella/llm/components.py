"""Connected components by randomised contraction, and links inside buckets without all pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import Scratch

#: So few edges that one task may finish them; a bound, whatever the input's size.
LAST_EDGES = 16_384
#: The most keys that are broadcast because they hold many rows.
HOT_KEYS = 256


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    if parent:
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "root"])


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); the root is a component's least node.

    Each round every node points to the neighbour (or itself) with the least random priority and
    the graph is contracted along these pointers, so that edges shrink geometrically even on long
    chains; hubs are pre-aggregated before the shuffle and their join is split by AQE.  The maps
    are then composed backwards.  Null ends and self-loops link nothing.
    """
    e = scratch.keep(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps = []
    while (left := e.count()) > LAST_EDGES:
        rank = F.struct(F.xxhash64(F.lit(len(maps) // 2), F.col("y")).alias("p"), F.col("y"))
        both = e.selectExpr("a x", "b y").unionAll(e.selectExpr("b x", "a y")).unionAll(e.selectExpr("a x", "a y")).unionAll(e.selectExpr("b x", "b y"))
        to = scratch.keep(both.groupBy("x").agg(F.min(rank).alias("m")).selectExpr("x", "m.y t"), "to")
        maps.append(to)
        new = e.join(to.selectExpr("x a", "t s"), "a").join(to.selectExpr("x b", "t"), "b").where("s <> t")
        old, e = e, scratch.keep(new.select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).distinct(), "edges")
        scratch.drop(old)
    out = e.coalesce(1).mapInArrow(_finish, "node long, root long") if left else e.selectExpr("a node", "b root")
    for to in reversed(maps):
        out = to.join(out.withColumnRenamed("node", "t"), "t", "left").select(F.col("x").alias("node"), F.coalesce("root", "t").alias("root"))
    out = scratch.keep(out, "components")
    if not maps:
        return out
    least = scratch.keep(out.groupBy("root").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")), "least")
    return scratch.keep(join_hot(out, least, "root", "n").select("node", F.col("least").alias("root")), "components")


def spread(rows: DataFrame, item: str, blocks) -> DataFrame:
    """Adds ``blk``: buckets of more than one block become pairs of blocks.

    ``blocks`` is a column, the same for all rows of a bucket.  A row of block i goes to every pair
    that holds i, so that each two rows of a bucket meet in some task and none holds over two blocks.
    """
    nb = F.coalesce(blocks, F.lit(1)).cast("int")
    mine = F.pmod(F.xxhash64(item), nb).cast("int")
    pair = F.transform(F.sequence(F.lit(0), nb - 1), lambda j: F.least(mine, j) * nb + F.greatest(mine, j))
    return rows.withColumn("blk", F.explode(F.when(nb > 1, pair).otherwise(F.array(F.lit(0)))))


def join_hot(rows: DataFrame, per: DataFrame, key: str, n: str) -> DataFrame:
    """``rows`` joined with ``per``, which has one row for each key and in ``n`` how many of ``rows`` hold it.

    Keys that hold more than a HOT_KEYS-th of all rows are HOT_KEYS at most, whatever the data: they are
    broadcast.  The others are joined by a shuffle, in which none is large.  Both frames are read twice.
    """
    total = per.agg(F.sum(n)).first()[0] or 0
    hot = F.broadcast(per.where(F.col(n) > total // HOT_KEYS))
    rest = rows.join(hot.select(key), key, "left_anti").join(per.where(F.col(n) <= total // HOT_KEYS), key)
    return rows.join(hot, key).unionByName(rest)


def linked_in(order: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links among the rows of one bucket.

    near(i, rest) tells which of ``rest`` link to row i.  A row once reached is never tested
    against others that are, so a bucket of true copies costs one scan and gives m - 1 links.
    """
    rest, found = order, []
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            i = front.pop()
            hit = near(i, rest)
            if hit.any():
                got = rest[hit]
                found.extend((i, j) for j in got)
                front.extend(got)
                rest = rest[~hit]
    return found
