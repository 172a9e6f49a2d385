"""Substring dedup: paragraphs by MinHash banding, and the passages inside them by windows of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, documents, table
from tessella.llm.components import components, join_hot, linked_in, spread
from tessella.llm.words import Words, mix, run_hashes, slices, spans

SHINGLE, SIMILARITY = 5, 0.8
#: Bands and rows: at a similarity of 0.8 a pair shares a band with probability 0.993.
BANDS, ROWS = 7, 3
#: Shorter lines are no paragraphs: they have no whole shingle.
LEAST_LINE = SHINGLE
#: Shorter repeated runs are no passages.
LEAST_WORDS = 20
#: Shingles of a band's bucket that one task compares; larger buckets are dealt out in pairs of blocks.
BLOCK_SHINGLES = 1_000_000
#: Occurrences of an anchor that one task takes, some 100 MB with their windows; beyond, its windows are
#: counted one by one, in part before any shuffle.
HOT_ANCHOR = 50_000

_U = np.uint64
#: Bits of a shingle's hash that give way to its place among the words read together.
_PLACE = _U(2**28 - 1)
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)
_OTHER_BASE = 0xD6E8FEB86659FD93


def shingles(h: np.ndarray) -> np.ndarray:
    """Hashes of the runs of SHINGLE words, the first words of which stand at 0, 1, and so on."""
    out = np.zeros(max(len(h) - SHINGLE + 1, 0), np.uint64)
    for j in range(SHINGLE):
        out = mix(out * _U(31) + h[j : j + len(out)])
    return out


def band_keys(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A row of 64-bit band keys of the MinHash signature of each list of shingles (n of them, none empty)."""
    start = np.cumsum(n) - n
    key = np.tile(np.arange(BANDS, dtype=np.uint64), (len(n), 1))
    for band in range(BANDS):
        for r in range(ROWS):
            low = np.minimum.reduceat(x * _SEEDS[band * ROWS + r] >> _U(20), start) if len(n) else start.astype(_U)
            key[:, band] = mix(key[:, band] * _U(0xC2B2AE3D27D4EB4F) + low)
    return key.view(np.int64)


def windows(w: Words, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of LEAST_WORDS words of each text, and the place of the anchor of each (its
    shingle of least hash, the first if tied); ``x`` are the shingles of all words.

    An anchor depends on its window's words only, so equal windows have equal anchors.
    """
    starts = np.flatnonzero(w.places() + LEAST_WORDS <= np.repeat(w.lens, w.lens))
    if not len(starts):
        return starts, starts
    low = x & ~_PLACE | np.arange(len(x), dtype=np.uint64)
    span, reach = 1, LEAST_WORDS - SHINGLE + 1
    while span < reach:
        step = min(span, reach - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    return starts, (low[starts] & _PLACE).astype(np.int64)


# ---- what a text holds ----------------------------------------------------------------------

_KEYS = [f"k{i}" for i in range(BANDS)]
_UNITS = "doc_id long, t int, para boolean, at int, upto int, word int, n int, p1 long, p2 long, " + ", ".join(f"{k} long" for k in _KEYS)
_FOUND = "doc_id long, t int, first int, last int, removed boolean, keep_id long"
_FOUND_SCHEMA = pa.schema([("doc_id", pa.int64()), ("t", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("removed", pa.bool_()), ("keep_id", pa.int64())])
_UNIT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("t", pa.int32()), ("para", pa.bool_()), *((c, pa.int32()) for c in ("at", "upto", "word", "n")), *((c, pa.int64()) for c in ("p1", "p2", *_KEYS))])


def _unit_rows(ids: np.ndarray, t: np.ndarray, para: bool, at: np.ndarray, cols: list[np.ndarray]) -> pa.RecordBatch:
    arrays = [ids, t, np.full(len(ids), para), at.astype(np.int32), *cols]
    arrays = [pa.array(a, f.type) for a, f in zip(arrays, _UNIT_SCHEMA)]
    return pa.RecordBatch.from_arrays(arrays + [pa.nulls(len(ids), f.type) for f in list(_UNIT_SCHEMA)[len(arrays) :]], schema=_UNIT_SCHEMA)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, t) -> paragraphs (places in characters, ``word`` in words, a 128-bit digest
    p1, p2 of their words and their band keys) and anchors (places in words, the shingle's hash in p1)."""
    for b in slices(batches):
        ids, t = b.column(0).to_numpy(), b.column(2).to_numpy()
        w = Words(b.column(1))
        h = w.hashes
        x = shingles(h)

        edge = np.union1d(w.off, np.flatnonzero(w.raw == 10) + 1)
        s, e = edge[:-1], edge[1:] - (w.raw[edge[1:] - 1] == 10 if len(w.raw) else 0)
        word = np.searchsorted(w.start, edge)
        word, n = word[:-1], np.diff(word)
        long = n >= LEAST_LINE
        s, e, word, n = s[long], e[long], word[long], n[long]
        text = np.searchsorted(w.off, s, "right") - 1
        char = w.characters()
        at, upto = char[s] - char[w.off[text]], char[e] - char[w.off[text]]
        keys = band_keys(spans(x, word, n - SHINGLE + 1), n - SHINGLE + 1)
        digest = [mix(run_hashes(h, word, n) + n.astype(_U)).view(np.int64), mix(run_hashes(mix(h), word, n, _OTHER_BASE) ^ n.astype(_U)).view(np.int64)]
        yield _unit_rows(ids[text], t[text], True, at, [upto, word - w.first[text], n, *digest, *keys.T])

        _, place = windows(w, x)
        place = place[np.diff(place, prepend=-1) != 0]
        text = np.searchsorted(w.first, place, "right") - 1
        none = np.zeros(len(place), np.int32)
        yield _unit_rows(ids[text], t[text], False, place - w.first[text], [none, none, none, x[place].view(np.int64)])


_WANTED = "para boolean, hot boolean, key long, doc_id long, t int, at int, hashes array<long>"
_WANTED_SCHEMA = pa.schema([("para", pa.bool_()), ("hot", pa.bool_()), ("key", pa.int64()), ("doc_id", pa.int64()), ("t", pa.int32()), ("at", pa.int32()), ("hashes", pa.list_(pa.int64()))])


def _lists(values: np.ndarray, n: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(values.view(np.int64)))


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, t, anchors wanted, those of them that are hot, paragraphs wanted as num, word, n)
    -> for each anchor the hashes of the windows, from ``at`` on, that have it; for each paragraph (key: num)
    its different shingles."""
    for b in slices(batches):
        ids, t = b.column(0).to_numpy(), b.column(2).to_numpy()
        w = Words(b.column(1))
        h = w.hashes
        x = shingles(h)

        starts, place = windows(w, x)
        mark = np.zeros(len(h) + 1, np.int8)
        for level, ats in ((1, b.column(3)), (2, b.column(4))):
            mark[ats.flatten().to_numpy() + np.repeat(w.first[:-1], ats.value_lengths().to_numpy())] = level
        starts, place = starts[mark[place] > 0], place[mark[place] > 0]
        new = np.flatnonzero(np.diff(place, prepend=-1))
        text = np.searchsorted(w.first, starts[new], "right") - 1
        many = np.diff(np.append(new, len(starts)))
        cols = [np.zeros(len(new), bool), mark[place[new]] == 2, x[place[new]].view(np.int64), ids[text], t[text], (starts[new] - w.first[text]).astype(np.int32)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, cols), _lists(run_hashes(h, starts, LEAST_WORDS), many)], schema=_WANTED_SCHEMA)

        paras = b.column(5)
        if len(own := paras.flatten()):
            num, word, n = (own.field(k).to_numpy() for k in range(3))
            word = word + np.repeat(w.first[:-1], paras.value_lengths().to_numpy())
            n = n - SHINGLE + 1
            values, of = spans(x, word, n), np.repeat(np.arange(len(num)), n)
            by = np.lexsort((values, of))
            values, of = values[by], of[by]
            first = np.ones(len(values), bool)
            first[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
            none = pa.nulls(len(num), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(num), bool)), pa.array(np.zeros(len(num), bool)), pa.array(num), pa.nulls(len(num), pa.int64()), none, none, _lists(values[first], np.bincount(of[first], minlength=len(num)))], schema=_WANTED_SCHEMA)


def _by_key(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups from rows sorted by their first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([b.column(k).to_numpy() for k in range(keys)])
        other = np.flatnonzero((key != key[:, -1:]).any(0))
        cut = int(other[-1]) + 1 if len(other) else 0  # the last group may go on in the next batch
        if held and (cut or any(held[0].column(k)[0].as_py() != key[k, 0] for k in range(keys))):
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = []
        elif cut:
            yield pa.Table.from_batches([b.slice(0, cut)])
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, doc_id, t, at, hashes) sorted by key -> the runs of windows that stand at two places (_FOUND)."""
    for rows in _by_key(batches, 1):
        rows = rows.combine_chunks()
        lists = rows.column("hashes").combine_chunks()
        n, h = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
        doc, t = (np.repeat(rows.column(c).to_numpy(), n) for c in ("doc_id", "t"))
        at = np.repeat(rows.column("at").to_numpy().astype(np.int64) - (np.cumsum(n) - n), n) + np.arange(len(h))
        by = np.lexsort((at, t, doc, h))
        h, doc, t, at = h[by], doc[by], t[by], at[by]
        again = np.zeros(len(h), bool)  # rows that repeat a document
        again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]) & (t[1:] == t[:-1]) & (at[1:] == at[:-1])
        h, doc, t, at = h[~again], doc[~again], t[~again], at[~again]
        new = np.flatnonzero(np.concatenate([np.ones(1, bool), h[1:] != h[:-1]]))
        size = np.diff(np.append(new, len(h)))
        keep, gone = np.repeat(doc[new], size), np.ones(len(h), bool)
        gone[new] = False
        many = np.repeat(size > 1, size)
        doc, t, at, keep, gone = doc[many], t[many], at[many], keep[many], gone[many]
        by = np.lexsort((at, t, doc))
        doc, t, at, keep, gone = doc[by], t[by], at[by], keep[by], gone[by]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (t[1:] != t[:-1]) | (at[1:] != at[:-1] + 1) | (keep[1:] != keep[:-1]) | (gone[1:] != gone[:-1])
        first = np.flatnonzero(new)
        last = at[np.append(first[1:], len(at)) - 1] + LEAST_WORDS if len(first) else at
        cols = [doc[first], t[first], at[first], last, gone[first], keep[first]]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(f.type.to_pandas_dtype())) for c, f in zip(cols, _FOUND_SCHEMA)], schema=_FOUND_SCHEMA)


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs (_FOUND) sorted by document -> its longest stretches of words that share their fate (_FOUND)."""
    for rows in _by_key(batches, 2):
        doc, t, s, e, gone, keep = (rows.column(k).to_numpy() for k in range(6))
        new = np.flatnonzero(np.concatenate([np.ones(1, bool), (doc[1:] != doc[:-1]) | (t[1:] != t[:-1])]))
        out: list[tuple] = []
        for a, b in zip(new.tolist(), np.append(new[1:], len(doc)).tolist()):
            fate, kept = np.zeros(int(e[a:b].max()) + 1, np.int8), np.zeros(int(e[a:b].max()) + 1, np.int64)
            own = list(zip(s[a:b].tolist(), e[a:b].tolist(), gone[a:b].tolist(), keep[a:b].tolist()))
            for wanted in (True, False):  # words of a window that stays stay
                for i, j, g, k in reversed(own):
                    if g == wanted:
                        fate[i:j], kept[i:j] = 1 if g else 2, k
            cut = np.flatnonzero(np.diff(fate, prepend=0)).tolist()
            out += [(int(doc[a]), int(t[a]), i, j, bool(fate[i] == 1), int(kept[i])) for i, j in zip(cut, cut[1:]) if fate[i]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [()] * 6, _FOUND_SCHEMA)], schema=_FOUND_SCHEMA)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, blk, num, hashes) sorted by bucket -> links of exact Jaccard similarity >= SIMILARITY."""
    for rows in _by_key(batches, 2):
        rows = rows.combine_chunks()
        key, blk, num = (rows.column(k).to_numpy() for k in range(3))
        lists = rows.column(3).combine_chunks()
        size, x = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy()
        off = np.concatenate([[0], np.cumsum(size)])
        new = np.flatnonzero(np.concatenate([np.ones(1, bool), (key[1:] != key[:-1]) | (blk[1:] != blk[:-1])]))
        rows_in = np.diff(np.append(new, len(key)))
        a, b = [], []
        twos = new[rows_in == 2]
        if len(twos):  # most buckets: equal shingles of two rows stand side by side once sorted
            both = size[twos] + size[twos + 1]
            values, of = spans(x, off[twos], both), np.repeat(np.arange(len(twos)), both)
            by = np.lexsort((values, of))
            values, of = values[by], of[by]
            same = np.bincount(of[1:][(values[1:] == values[:-1]) & (of[1:] == of[:-1])], minlength=len(twos))
            near = same >= SIMILARITY * (both - same)
            a.append(num[twos[near]]), b.append(num[twos[near] + 1])
        for s, n in zip(new[rows_in > 2].tolist(), rows_in[rows_in > 2].tolist()):
            i, j = _linked(x[off[s] : off[s + n]], size[s : s + n])
            a.append(num[s + i]), b.append(num[s + j])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def _linked(x: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the linked ones among lists of shingles (each of different ones, one list after another)."""
    off = np.concatenate([[0], np.cumsum(size)])
    ids = np.unique(x, return_inverse=True)[1]
    mark = np.zeros(len(ids) + 1, bool)

    def near(i, rest):
        mark[ids[off[i] : off[i + 1]]] = True
        if len(rest) * 4 < len(size):
            both = np.array([mark[ids[off[j] : off[j + 1]]].sum() for j in rest])
        else:
            both = np.add.reduceat(mark[ids].astype(np.int32), off[:-1])[rest]
        mark[ids[off[i] : off[i + 1]]] = False
        return both >= SIMILARITY * (size[rest] + size[i] - both)

    found = np.array(linked_in(np.arange(len(size)), near), np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


# ---- the operator ---------------------------------------------------------------------------

_AT = ["doc_id", "t", "at"]


def repeated_passages(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """One row for each repeated passage of a document.

    doc_id; kind ``paragraph`` (first, last: characters, the last exclusive) or ``passage`` (words,
    likewise); n_words; component (paragraphs only: a digest of the one that stays); keep_id, the
    least document that holds the component or the passage's first words; removed: false for the one
    occurrence that stays.

    Paragraphs are lines of at least LEAST_LINE words.  Passages are all runs of LEAST_WORDS words
    or more that stand at two places, to their exact ends, however they stand within paragraphs.
    The first place of every such window of LEAST_WORDS words stays whole: a run that goes is cut
    where it overlaps one that stays, so its row may be shorter.  Null and empty texts, rows with a
    null doc_id and an empty table have none; rows that repeat a doc_id and text count as one, texts
    that share a doc_id each count; of ties the earliest stays.  Other columns, whatever their names,
    are not looked at.
    """
    docs = documents(docs).where("doc_id is not null and text is not null").withColumn("t", F.hash("text"))
    units = scratch.keep(docs.mapInArrow(_units, _UNITS), "units")

    # different paragraphs, numbered; those that share a band with another one
    place = [*_AT, "word", "n"]
    ref = F.xxhash64(*_AT)
    kinds = units.where("para").groupBy("p1", "p2").agg(F.min(F.struct(*place, *_KEYS)).alias("x"), (F.min(ref) != F.max(ref)).alias("again"))
    kinds = kinds.select("p1", "p2", F.struct(*(F.col(f"x.{c}") for c in place)).alias("place"), "again", *(F.col(f"x.{k}") for k in _KEYS), F.monotonically_increasing_id().alias("num"))
    kinds = scratch.keep(kinds, "kinds")
    keyed = kinds.select(F.explode(F.array(*_KEYS)).alias("key"), "num", F.col("place.n").alias("n"))
    full = scratch.keep(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("weight")).where("c > 1").select("key", "weight"), "buckets")
    scratch.release()
    pairs = scratch.keep(keyed.select("key", "num").join(full, "key"), "pairs")
    none = lambda kind: F.lit(None).cast(kind)
    near = pairs.select("num").distinct().withColumn("near", F.lit(True))
    some = kinds.drop(*_KEYS).join(near, "num", "left").where("again or near")
    all_kinds, kinds = kinds, scratch.keep(some, "some-kinds")
    scratch.drop(all_kinds)
    near = kinds.where("near").select("place.doc_id", "place.t", none("int").alias("at"), none("int").alias("hot"), F.struct("num", "place.word", "place.n").alias("p"))

    # anchors that stand at two places
    anchors = units.where("not para").select("p1", *_AT)
    often = anchors.groupBy("p1").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("p1", (F.col("c") > HOT_ANCHOR).alias("hot"))
    often = scratch.keep(often, "often")
    hits = anchors.join(often, "p1").select(*_AT, F.when(F.col("hot"), F.col("at")).alias("hot"), none("struct<num:long,word:int,n:int>").alias("p"))

    # one more look at the texts that hold either; of the units only the places of paragraphs are needed after that
    wanted = hits.unionAll(near).groupBy("doc_id", "t").agg(F.collect_list("at").alias("ats"), F.collect_list("hot").alias("hots"), F.collect_list("p").alias("ps"))
    scratch.release()
    wanted = scratch.keep(wanted, "wanted")
    places = scratch.keep(units.where("para").select(*_AT, "upto", "n", "p1", "p2"), "places")
    scratch.drop(units)
    scratch.drop(often)
    scratch.release()
    looked = scratch.keep(docs.join(wanted, ["doc_id", "t"]).select("doc_id", "text", "t", "ats", "hots", "ps").mapInArrow(_looked_up, _WANTED), "looked-up")
    scratch.drop(wanted)
    scratch.release()

    sets = looked.where("para").select(F.col("key").alias("num"), "hashes").dropDuplicates(["num"])
    rows = spread(pairs, "num", F.ceil(F.col("weight") / BLOCK_SHINGLES))
    rows = rows.join(sets, "num").select("key", "blk", "num", "hashes").repartition("key", "blk").sortWithinPartitions("key", "blk", "num")
    roots = components(rows.mapInArrow(_verify, "a long, b long"), scratch)
    scratch.drop(pairs)
    grouped = kinds.join(roots.withColumnRenamed("node", "num"), "num", "left").where("again or root is not null")
    grouped = scratch.keep(grouped.select("p1", "p2", "place", F.coalesce("root", "num").alias("root")), "grouped")
    least = scratch.keep(grouped.groupBy("root").agg(F.min(F.struct("place", "p1")).alias("keep"), F.count(F.lit(1)).alias("c")), "least")
    named = join_hot(grouped.select("p1", "p2", "root"), least, "root", "c").select("p1", "p2", F.col("keep.p1").alias("component"), F.struct(*(F.col(f"keep.place.{c}") for c in _AT)).alias("keep"))
    found = places.join(scratch.keep(named, "named"), ["p1", "p2"])
    found = found.select("doc_id", F.lit("paragraph").alias("kind"), F.col("at").alias("first"), F.col("upto").alias("last"), F.col("n").alias("n_words"), "component", F.col("keep.doc_id").alias("keep_id"), (F.struct(*_AT) != F.col("keep")).alias("removed"), "t").distinct()
    scratch.release()
    return found.drop("t").unionAll(_repeated_windows(looked.where("not para").drop("para"), scratch))


def _repeated_windows(looked: DataFrame, scratch: Scratch) -> DataFrame:
    """Windows at two places, joined to passages.

    Windows are compared with those of the same anchor.  Of an anchor at over HOT_ANCHOR places no task
    gets all: its windows are counted by hash, in part before the shuffle, and joined with the result.
    """
    found = looked.where("not hot").select("key", *_AT, "hashes").repartition("key").sortWithinPartitions("key").mapInArrow(_alike, _FOUND)
    many = looked.where("hot")
    if not many.isEmpty():
        each = many.select("doc_id", "t", "at", F.posexplode("hashes").alias("i", "h")).select("h", F.struct("doc_id", "t", (F.col("at") + F.col("i")).alias("at")).alias("place"))
        both = each.groupBy("h").agg(F.min("place").alias("keep"), F.max("place").alias("other"), F.count(F.lit(1)).alias("c"))
        both = scratch.keep(both.where("keep <> other").drop("other"), "hot-windows")
        runs = join_hot(each, both, "h", "c").select("place.doc_id", "place.t", F.col("place.at").alias("first"), (F.col("place.at") + LEAST_WORDS).alias("last"), (F.col("place") != F.col("keep")).alias("removed"), F.col("keep.doc_id").alias("keep_id"))
        found = found.unionAll(runs)
    whole = found.repartition("doc_id", "t").sortWithinPartitions("doc_id", "t", "first", "last").mapInArrow(_passages, _FOUND)
    return whole.select("doc_id", F.lit("passage").alias("kind"), "first", "last", (F.col("last") - F.col("first")).alias("n_words"), F.lit(None).cast("long").alias("component"), "keep_id", "removed")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"), Scratch(spark, "paragraphs"))
