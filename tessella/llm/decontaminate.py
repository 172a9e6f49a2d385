"""Benchmark decontamination: n-gram seeds that no match can lack, then Smith-Waterman alignment."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, documents, table
from tessella.llm.words import Words, slices, spans

MATCH, MISMATCH, GAP = 2, -1, -1
#: Least alignment score as a share of the item's own.
SHARE = 0.6
#: Bytes of item texts that are broadcast at once; larger benchmarks go in several rounds of whole items.
ITEM_BYTES = 64_000_000


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local score with MATCH, MISMATCH and GAP, and the part of ``passage`` it covers: of several
    the one that starts first, then the one that ends first.

    A row at a time; a cell is its score and, in the low bits, how early its alignment starts, so that
    the greater cell is the better one.
    """
    passage = np.asarray(passage)
    n, one = len(passage), np.int64(1) << 32
    column = np.arange(n + 1)
    empty = one - 1 - column
    row, best = empty, (0, 0, 0)
    gaps = column * (-GAP * one)
    for a in item:
        cell = empty.copy()
        cell[1:] = np.maximum(row[:-1] + np.where(passage == a, MATCH * one, MISMATCH * one), row[1:] + GAP * one)
        row = np.maximum.accumulate(np.maximum(cell, empty) + gaps) - gaps
        row = np.where(row < one, empty, row)
        top = int(row.argmax())
        s, f = divmod(int(row[top]), int(one))
        f = int(one) - 1 - f
        if s > best[0] or s == best[0] and (f, top) < best[1:]:
            best = (s, f, top)
    return best


class Items:
    """The test items as word numbers, and the n-grams by which training text is joined to them.

    A match of an item of n words has m <= n equal words and at most 2 m - 1.2 n other steps, so it
    spans 1.8 n words at most, 0.6 n of them the item's at least, and its equal words stand in at
    most 2 m - 1.2 n + 1 runs, hence hold 0.2 n - 1 of the item's pairs of words.  Items of over 5
    words are sought by pairs, shorter ones by words.  (Figures for SHARE 0.6 and the scores above.)

    Seeds are the rarest of an item's n-grams (by how many places of the items hold them), so many
    that with any fewer n-grams than a match must have, no match can lack them all.  Rarity decides
    only how much is looked at, not what is found.
    """

    def __init__(self, rows: list[tuple[int, str]]):
        words = Words(pa.array([t for _, t in rows], pa.string()), punctuation=True, fold=True)
        self.vocab, number = np.unique(words.hashes, return_inverse=True)
        number = number.astype(np.int64) + 1
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.vocab & np.uint64(0xFFFF)).astype(np.int64)] = True
        found = [(r[0], number[a:b]) for r, a, b in zip(rows, words.first, words.first[1:]) if b > a]
        self.ids, self.items = [i for i, _ in found], [w for _, w in found]
        self.base = len(self.vocab) + 1
        n = np.array([len(w) for w in self.items], np.int64)
        self.least = np.array([math.ceil(round(SHARE * k, 6)) for k in n.tolist()], np.int64)
        self.span = np.array([int(round((3 - 2 * SHARE) * k, 6)) for k in n.tolist()], np.int64)
        pairs = np.array([math.ceil(round((2 * SHARE - 1) * k - 1, 6)) for k in n.tolist()], np.int64)
        self.hits = np.where(pairs >= 1, pairs, self.least)
        grams = [w[:-1] * self.base + w[1:] if by_pairs else w for w, by_pairs in zip(self.items, pairs >= 1)]
        own = np.repeat(np.arange(len(grams)), [len(g) for g in grams]) if grams else np.empty(0, np.int64)
        flat = np.concatenate([np.empty(0, np.int64), *grams])
        self.all, at, often = np.unique(flat, return_inverse=True, return_counts=True)
        by = np.lexsort((flat, -often[at], own))  # an item's n-grams, the commonest first
        rank = np.arange(len(by)) - np.searchsorted(own[by], own[by])
        seed = np.zeros(len(flat), bool)
        seed[by[rank >= self.hits[own[by]] - 1]] = True
        held = np.unique(np.stack([at, own, seed], axis=1), axis=0) if len(flat) else np.empty((0, 3), np.int64)
        last = np.ones(len(held), bool)  # an n-gram at several places of an item is a seed if one of them is
        last[:-1] = (held[1:, :2] != held[:-1, :2]).any(1)
        held = held[last]
        self.start = np.searchsorted(held[:, 0], np.arange(len(self.all) + 1))
        self.of, self.seed = held[:, 1], held[:, 2].astype(bool)

    def numbers(self, words: Words) -> np.ndarray:
        """The number of each word that an item holds, else 0."""
        h, out = words.hashes, np.zeros(len(words.start), np.int64)
        if len(self.vocab):
            at = np.flatnonzero(self.maybe[(h & np.uint64(0xFFFF)).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.vocab, h[at]), len(self.vocab) - 1)
            out[at] = np.where(self.vocab[k] == h[at], k + 1, 0)
        return out

    def joined(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers, and text, item and place of the n-grams that texts share with items of which
        they hold a seed, sorted."""
        nums, none = self.numbers(words), np.empty(0, np.int64)
        if not len(self.all):
            return nums, none, none, none
        known = nums > 0
        two = known[:-1] & known[1:]
        inner = words.first[1:-1]
        two[inner[(inner > 0) & (inner < len(nums))] - 1] = False  # a pair lies in one text
        two = np.flatnonzero(two)
        one = np.flatnonzero(known) if self.all[0] < self.base else none
        at = np.concatenate([one, two])
        grams = np.concatenate([nums[one], nums[two] * self.base + nums[two + 1]])
        k = np.minimum(np.searchsorted(self.all, grams), len(self.all) - 1)
        hit = self.all[k] == grams
        at, k = at[hit], k[hit]
        text = np.searchsorted(words.first, at, "right") - 1
        n = self.start[k + 1] - self.start[k]
        of, at, text = spans(np.arange(len(self.of)), self.start[k], n), np.repeat(at, n), np.repeat(text, n)
        item = self.of[of]
        key = text * len(self.items) + item
        seeded = np.unique(key[self.seed[of]])
        with_seed = seeded[np.minimum(np.searchsorted(seeded, key), len(seeded) - 1)] == key if len(seeded) else np.zeros(len(key), bool)
        text, item, at = text[with_seed], item[with_seed], at[with_seed]
        by = np.lexsort((at, item, text))
        return nums, text[by], item[by], at[by]

    def regions(self, words: Words) -> Iterator[tuple[int, int, np.ndarray, int]]:
        """(text, item's place, words, first word's place): the stretches of texts outside which no match can lie."""
        nums, text, item, at = self.joined(words)
        if not len(at):
            return
        upto = np.arange(len(item)) + self.hits[item] - 1
        end = np.minimum(upto, len(item) - 1)
        ok = (upto < len(item)) & (item[end] == item) & (text[end] == text) & (at[end] - at < self.span[item])
        text, item, at = text[ok], item[ok], at[ok]
        lo, hi = np.maximum(at - self.span[item], words.first[text]), np.minimum(at + self.span[item] + 1, words.first[text + 1])
        new = np.flatnonzero(np.concatenate([np.ones(1, bool), (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (lo[1:] > hi[:-1])])) if len(item) else item
        for s, e in zip(new.tolist(), np.append(new[1:], len(item)).tolist()):
            k, a, b = int(item[s]), int(lo[s]), int(hi[e - 1])
            mine = np.concatenate([[0], np.cumsum(np.isin(nums[a:b], self.items[k]))])
            width = min(int(self.span[k]), b - a)
            full = np.flatnonzero(mine[width:] - mine[:-width] >= self.least[k])
            if len(full):
                first, last = a + int(full[0]), a + int(full[-1]) + width
                yield int(text[s]), k, nums[first:last], first - int(words.first[text[s]])

    def matches(self, words: Words) -> list[tuple[int, int, float, int, int]]:
        """(text, item_id, score, first word, last word) of the best match of each text and item."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for text, k, nums, at in self.regions(words):
            s, f, e = smith_waterman(self.items[k], nums)
            if s >= SHARE * MATCH * len(self.items[k]) and (text, k) not in best or s > best.get((text, k), (math.inf,))[0]:
                best[text, k] = (s, at + f, at + e)
        return [(text, self.ids[k], s / (MATCH * len(self.items[k])), f, e) for (text, k), (s, f, e) in best.items()]


def _rounds(bench: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in rounds of ITEM_BYTES at most, never an item cut."""
    held, size = [], 0
    for r in bench.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null and item_id is not null").distinct().orderBy("item_id", "text").toLocalIterator():
        held.append((r[0], r[1]))
        size += 4 * len(r[1])
        if size > ITEM_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def contaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word): passages that copy or edit a test item.

    score: alignment score over the item's own, at least SHARE; the words are places in the
    document's words (case folded, without ASCII punctuation), the last exclusive.  Null and empty
    texts hold and match nothing, an empty table gives none; repeated document rows give repeated
    results, items that share a text one each; of several copies in one document the best counts,
    the earliest if tied.  Other columns, whatever their names, are not looked at.
    """
    out = None
    for rows in _rounds(bench):
        items = Items(rows)
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def align(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                cols = list(zip(*shared.value.matches(Words(b.column(1), punctuation=True, fold=True)))) or [()] * 5
                text, *cols = (pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())))
                yield pa.RecordBatch.from_arrays([b.column(0).take(text), *cols], ["doc_id", "item_id", "score", "first_word", "last_word"])

        one = documents(docs).mapInArrow(align, "doc_id long, item_id long, score double, first_word int, last_word int")
        out = one if out is None else out.unionAll(one)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, first_word int, last_word int")
    return out


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: rows whose text has a passage of the benchmark go, whatever their doc_id.

    Rows are known by their doc_id and a hash of their text.  Columns keep their names, types and order.
    """
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    keyed = docs.select(key.alias("doc_id"), "text")
    found = Scratch(spark, "decontaminate").keep(contaminated(keyed, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "found")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    return docs.select(key.alias("key"), whole).join(found.withColumnRenamed("doc_id", "key"), "key", "left_anti").select("row.*")
