"""Quality classifier by importance resampling of hashed n-gram models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import Scratch, documents, table
from tessella.llm.words import M1, Words, mix, slices

#: Buckets of the hashed words, and of the hashed word pairs.
BUCKETS = 1 << 18
#: The only sample: labelled rows, those with the least hash of their doc_id, from which the target
#: model and the number of documents to take are fitted.  The raw model, the weights and the draw cover
#: every document.
LABELLED = 50_000
#: Occurrences in a bucket, of words and of word pairs, that the raw model lends the target model.
#: Measured on check_s by models of the other half of the labelled rows, with unit noise: 93 % of the good,
#: 14 % of the toxic and 1 % of the poor documents are taken (words alone, 30: 87, 54 and 11 %).
PRIORS = (1.0, 300.0)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words and of the word pairs (from BUCKETS on; a text's first pair is its first
    word alone) of all texts, and where each text's words begin."""
    w = Words(texts)
    h = w.hashes
    before = np.roll(h, 1)
    before[w.first[:-1][w.lens > 0]] = 0
    low = np.uint64(BUCKETS - 1)
    return (h & low).astype(np.int64), (mix(before * M1 + h) & low).astype(np.int64) + BUCKETS, w.first


def _labelled(labels: DataFrame) -> dict[int, int]:
    """doc_id -> 1 for good documents (quality 1, not toxic), else 0, of LABELLED rows at most."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null and quality is not null and toxic is not null")
    one = known.groupBy("doc_id").agg((F.min("quality") == 1).alias("q"), F.max("toxic").alias("t"))
    rows = one.select("doc_id", (F.col("q") & (F.col("t") == 0)).cast("int").alias("good")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED).collect()
    return {r[0]: r[1] for r in rows}


def log_ratios(docs: DataFrame, folds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """log(target / raw) of each bucket, raw counted over all documents: three rows, with the target
    counted over the documents of both ``folds``, of the first and of the second.

    The target model is smoothed by the raw one, so that a bucket too rare to tell counts as 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(folds)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((3, 2 * BUCKETS), np.int64)
        for b in slices(batches):
            ids = b.column(0).fill_null(-1).to_numpy()
            one, two, first = features(b.column(1))
            mine = [np.repeat(np.isin(ids, f), np.diff(first)) for f in shared.value]
            for x in (one, two):
                _add(n[0], x)
                for j in (0, 1):
                    _add(n[j + 1], x[mine[j]])
            if n[0].max() > 1 << 30:
                yield packed(n)
                n[:] = 0
        yield packed(n)

    def packed(n: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(n[0])
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(m[at].astype(np.int32)) for m in n)], ["k", "raw", "a", "b"])

    # 2 * BUCKETS rows at most, whatever the corpus.
    got = documents(docs).mapInArrow(count, "k int, raw int, a int, b int").groupBy("k").agg(F.sum("raw"), F.sum("a"), F.sum("b")).toArrow()
    n = np.zeros((3, 2 * BUCKETS))
    for j in range(3):
        n[j, got.column(0).to_numpy()] = got.column(j + 1).to_numpy()
    target = np.stack([n[1] + n[2], n[1], n[2]])
    share = target[:, :BUCKETS].sum(1, keepdims=True) / max(n[0, :BUCKETS].sum(), 1)
    prior = np.repeat(PRIORS, BUCKETS)
    return np.log((target + prior) / (n[0] * share + prior))


def _add(n: np.ndarray, x: np.ndarray) -> None:
    """Counts ``x`` in, in time that depends on its length alone where it is short."""
    if len(x) < BUCKETS:
        at, c = np.unique(x, return_counts=True)
        n[at] += c
    else:
        n += np.bincount(x, minlength=len(n))


def weights(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """(doc_id, log_weight, by_a, by_b, draw): the log-likelihood ratio of the text by the models of both
    folds, of each, and with Gumbel noise."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, text_weights(b.column(1), shared.value))], ["doc_id", "log_weight", "by_a", "by_b"])

    rows = documents(docs).mapInArrow(score, "doc_id long, log_weight double, by_a double, by_b double")
    return rows.withColumn("draw", F.col("log_weight") + gumbel("doc_id"))


def gumbel(name: str, seed: int = 7):
    """-log(-log u), u in (0, 1) from the document's id: the same draw however often a task runs."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(name).cast("long")), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def text_weights(texts: pa.Array, ratios: np.ndarray) -> np.ndarray:
    """log P(text | target) - log P(text | raw) by each row of ``ratios``: the sum over its words and word pairs."""
    one, two, first = features(texts)
    out = np.empty((len(ratios), len(texts)))
    for j, r in enumerate(ratios):
        total = np.concatenate([[0.0], np.cumsum(r[one] + r[two])])
        out[j] = total[first[1:]] - total[first[:-1]]
    return out


def cut(scores: list[float], good: list[int]) -> float:
    """The weight from which documents are taken: where the labelled sample is parted best."""
    if not scores:
        return -np.inf
    order = np.argsort(scores, kind="stable")
    s, g = np.array(scores)[order], np.array(good)[order]
    if g.all() or not g.any():
        return -np.inf if g.all() else np.inf
    # taking from place i on: good ones kept plus bad ones left out, as shares
    kept = 1 - np.concatenate([[0], np.cumsum(g)]) / g.sum()
    out = np.concatenate([[0], np.cumsum(1 - g)]) / (1 - g).sum()
    i = int(np.argmax(kept + out))
    return -np.inf if i == 0 else np.inf if i == len(s) else (s[i - 1] + s[i]) / 2


def kth_largest(rows: DataFrame, k: int) -> int | None:
    """The k-th largest of the column ``o`` (long), by narrowing its bits 12 at a time.

    Each round brings 4,096 counts to the driver, whatever the number of rows.
    """
    base, left = 0, k
    for shift in range(52, -13, -12):
        s = max(shift, 0)
        top = F.shiftrightunsigned(F.col("o").bitwiseXOR(F.expr("-9223372036854775808")), s)
        width = 12 if shift >= 0 else 12 + shift
        here = rows if shift == 52 else rows.where(F.shiftrightunsigned(F.col("o").bitwiseXOR(F.expr("-9223372036854775808")), s + width) == base)
        n = dict(map(tuple, here.groupBy(top.bitwiseAND((1 << width) - 1).alias("d")).count().collect()))
        for d in sorted(n, reverse=True):
            if left <= n[d]:
                base = (base << width) | d
                break
            left -= n[d]
        else:
            return None
        if s == 0:
            break
    return base - (1 << 63)


def resample(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> tuple[DataFrame, np.ndarray, float]:
    """(doc_id, log_weight, draw) of each row, the ratios, and the draw of the last one taken.

    Gumbel top-k: k rows are drawn without replacement, each in proportion to its importance weight
    P(text | target) / P(text | raw).  k is the number of rows whose weight reaches the one that parts
    the labelled sample best.  Draws are compared at a millionth.  Null texts count as empty (log weight
    0); repeated rows get the same draw and are taken or left together, as are all that tie with the
    last one, and all rows with a null doc_id and equal weights; without labels all rows are taken; of
    an empty table none; other columns, whatever their names, are not looked at.
    """
    known = _labelled(labels)
    # A document that its model has seen weighs more than its like: for the threshold each half of
    # the sample is weighed by the model of the other half.
    fold = {d: i % 2 for i, d in enumerate(known)}
    ratios = log_ratios(docs, tuple(np.array(sorted(d for d, g in known.items() if g and fold[d] == j), np.int64) for j in (0, 1)))
    rows = scratch.keep(weights(docs, ratios), "weights")
    sample = rows.sparkSession.createDataFrame([(d, fold[d], g) for d, g in known.items()], "doc_id long, fold int, good int")
    other = F.when(F.col("fold") == 0, F.col("by_b")).otherwise(F.col("by_a"))
    got = rows.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min(other), F.min("good")).collect()  # LABELLED rows at most
    least = cut([r[1] for r in got], [r[2] for r in got])
    if least == -np.inf:
        return rows, ratios, -np.inf
    k = rows.where(F.col("log_weight") >= F.lit(float(least))).count()
    last = kth_largest(rows.select(steps().alias("o")), k) if k else None
    return rows, ratios, np.inf if last is None else last / 1e6


def steps():
    return F.round(F.col("draw") * 1e6).cast("long")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its weight, its draw and whether it is taken."""
    rows, _, last = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark, "quality"))
    return rows.select("doc_id", "log_weight", "draw", _taken(last).alias("kept"))


def _taken(last: float):
    return F.lit(bool(last < 0)) if np.isinf(last) else steps() >= F.lit(round(last * 1e6))


def resampled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: the documents taken; each is weighed anew as it passes, so that no text is shuffled.

    Columns keep their names, values and order.
    """
    _, ratios, last = resample(docs, table(spark, sf_dir, "labels"), Scratch(spark, "quality-stage"))
    if np.isinf(last):
        return docs if last < 0 else docs.where(F.lit(False))
    shared = spark.sparkContext.broadcast(ratios[:1])

    @F.pandas_udf(T.DoubleType())
    def weight(text):
        import pandas as pd

        rows = pa.RecordBatch.from_arrays([pa.array(text, pa.string())], ["text"])
        some = [text_weights(b.column(0), shared.value)[0] for b in slices([rows], 0)]
        return pd.Series(np.concatenate(some) if some else np.empty(0))

    draw = weight(F.col("text").cast("string")) + gumbel("doc_id")
    return docs.where(F.round(draw * 1e6).cast("long") >= F.lit(round(last * 1e6)))
