"""SimHash fingerprints, linked through deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, documents, ids_and_texts
from tessella.llm.components import components, join_hot, linked_in, spread

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Three segments: of four differing bits at most, some segment holds at most one.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Rows of a signature's bucket that one task compares.
PER_BLOCK = 100_000


def fingerprint(text: str) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    h = np.array(_shingle_hashes(words), np.uint64)
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def _shingle_hashes(words: list[bytes]) -> list[int]:
    """XXH64 of every run of SHINGLE words (or of all, if fewer), as slices of the joined words."""
    joined, hash64 = b" ".join(words), xxhash.xxh64_intdigest
    n = len(words)
    if n <= SHINGLE:
        return [hash64(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: n - SHINGLE + 1].tolist()
    return [hash64(joined[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :].tolist())]


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts = ids_and_texts(b)
        fp = np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fp)], ["doc_id", "fp"])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (signature, blk, fp) sorted by bucket -> verified links inside each bucket."""
    key = fps = None

    def flush(key, fps):
        cut = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1
        start, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(fps)]])
        size, a, b = end - start, [], []
        for k in range(1, 8):  # small buckets: all of them at once, by distance within the bucket
            lone = np.repeat((size > k) & (size <= 8), size)
            i = np.flatnonzero(lone)
            i = i[i < np.repeat(end, size)[i] - k]
            near = np.bitwise_count(fps[i] ^ fps[i + k]) <= DISTANCE
            a.append(fps[i[near]]), b.append(fps[i[near] + k])
        for s, e in zip(start[size > 8], end[size > 8]):
            own = np.unique(fps[s:e])
            got = linked_in(np.arange(len(own)), lambda i, rest: np.bitwise_count(own[rest] ^ own[i]) <= DISTANCE)
            if got:
                x, y = np.array(got).T
                a.append(own[x]), b.append(own[y])
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            p = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(p[0].view(np.int64)), pa.array(p[1].view(np.int64))], ["a", "b"])

    for batch in batches:
        k = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
        f = batch.column(2).to_numpy().view(np.uint64)
        key, fps = (k, f) if key is None else (np.concatenate([key, k]), np.concatenate([fps, f]))
        last = np.flatnonzero(np.any(key != key[-1], axis=1))
        done = last[-1] + 1 if len(last) else 0
        if done:
            yield from flush(key[:done], fps[:done])
            key, fps = key[done:], fps[done:]
    if key is not None and len(fps):
        yield from flush(key, fps)


def signatures(fps: DataFrame) -> DataFrame:
    """(seg, sig, fp): each segment with one bit left out, the place left out being part of ``sig``."""
    def variants(at: int, width: int):
        part = F.shiftrightunsigned("fp", at).bitwiseAND((1 << width) - 1)
        seg = F.struct(F.lit(at).alias("at"), part.alias("part"))
        return F.transform(
            F.sequence(F.lit(0), F.lit(width - 1)),
            lambda i: F.struct(seg.alias("seg"), (part.bitwiseAND(F.expr(f"shiftleft(1L, {width})") - 1 - _bit(i)) + (i + at).cast("long") * (1 << 32)).alias("sig")),
        )

    return fps.select("fp", F.explode(F.concat(*(variants(*s) for s in SEGMENTS))).alias("v")).select("v.seg.at", "v.seg.part", "v.sig", "fp")


def _bit(i):
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def links(fps: DataFrame, per_block: int = PER_BLOCK) -> DataFrame:
    """Links (a, b) between distinct fingerprints; connectivity at DISTANCE bits is kept whole."""
    parts = None
    for at, width in SEGMENTS:
        p = fps.select(F.lit(at).alias("at"), F.shiftrightunsigned("fp", at).bitwiseAND((1 << width) - 1).alias("part"))
        parts = p if parts is None else parts.unionAll(p)
    # A signature holds two values of its segment, so its bucket is at most twice the larger one.
    hot = parts.groupBy("at", "part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > per_block // 2)
    rows = signatures(fps).select("sig", "fp").join(signatures_of_parts(hot), "sig", "left")
    rows = spread(rows, "fp", F.ceil(F.col("n") / per_block))
    rows = rows.select("sig", "blk", "fp").repartition("sig", "blk").sortWithinPartitions("sig", "blk")
    return rows.mapInArrow(_links, "a long, b long")


def signatures_of_parts(hot: DataFrame) -> DataFrame:
    out = None
    for at, width in SEGMENTS:
        one = hot.where(F.col("at") == at).select("n", F.col("part"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("i"))
        one = one.select("n", (F.col("part").bitwiseAND(F.lit((1 << width) - 1).cast("long") - _bit(F.col("i"))) + (F.col("i") + at).cast("long") * (1 << 32)).alias("sig"))
        out = one if out is None else out.unionAll(one)
    return out.groupBy("sig").agg((F.sum("n") * 2).alias("n"))


def simhash_groups(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``.

    Null or blank texts have fingerprint zero and link like any other; a null doc_id is carried
    along but names no component unless all its group's are null; repeated rows stay repeated; an
    empty table has no groups; other columns are not looked at.
    """
    rows = scratch.keep(documents(docs).mapInArrow(_fingerprints, "doc_id long, fp long"), "fingerprints")
    fps = scratch.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("c")), "distinct")
    named = scratch.keep(_rooted(fps, scratch), "named")
    least = scratch.keep(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "least")
    classes = scratch.keep(join_hot(named, least, "root", "n").select("fp", "component_id", "c"), "classes")
    return join_hot(rows, classes, "fp", "c").select("doc_id", "fp", "component_id")


def _rooted(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """``fps`` (one row for each fingerprint) with the ``root`` of its component."""
    roots = components(links(fps.select("fp")), scratch).withColumnRenamed("node", "fp")
    return fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.common import table

    got = simhash_groups(table(spark, sf_dir, "documents"), Scratch(spark, "simhash"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _row_key() -> list:
    """``id`` and ``x``: doc_id, the last of all where null, and what tells rows of one doc_id apart."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return [F.coalesce(doc_id, F.lit(2**63 - 1)).alias("id"), F.xxhash64(doc_id, text).alias("x")]


def _keyed_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.fromiter((fingerprint(t or "") for t in b.column(2).to_pylist()), np.uint64, b.num_rows).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], ["id", "x", "fp"])


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: of each group the row with the least doc_id stays; a null doc_id comes after all others.

    Rows that share a doc_id are told apart by their texts; of rows that repeat both, one stays.  Null
    and empty texts are one group.  Columns keep their names, types and order; texts are shuffled once.
    """
    scratch, text = Scratch(spark, "simhash-stage"), F.col("text").cast("string").alias("text")
    rows = docs.select(*_row_key(), text).mapInArrow(_keyed_fingerprints, "id long, x long, fp long")
    fps = scratch.keep(rows.groupBy("fp").agg(F.min(F.struct("id", "x")).alias("least")), "distinct")
    stay = scratch.keep(_rooted(fps, scratch).groupBy("root").agg(F.min("least").alias("least")).select("least.id", "least.x"), "stay")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    return docs.select(*_row_key(), whole).join(stay, ["id", "x"], "left_semi").dropDuplicates(["id", "x"]).select("row.*")
