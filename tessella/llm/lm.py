"""Language-model scores from an Elias-Fano trie of smoothed n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, documents, table
from tessella.llm.elias_fano import EliasFano, exists, load, save
from tessella.llm.words import Words, slices, spans

#: Discount of absolute discounting, at both levels.
DISCOUNT = 0.75
#: Tokens that a task gathers before it sorts and packs their n-grams, and in one row of the table of word numbers.
GATHER, BLOCK = 1_000_000, 65_536
#: Tokens (about) for each shard of the trie, and nodes of a shard's second level in one part of the third.
SHARD_TOKENS, PART_NODES = 8_000_000, 1 << 19
#: Tokens that a task counts before it passes their sums on.
COUNTED = 2_000_000
HELD_OUT, FOLDS = 2, 7
_U = np.uint64
#: The end of a text, which is no word.
END = (_U(0x2545F4914F6CDD1D), _U(0x9E6C63D0876A9A99))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each word (lower-cased A-Z) of all texts, each text's followed by END, and their numbers."""
    w = Words(texts)
    lens = w.lens + 1
    at = np.arange(len(w.start)) + np.repeat(np.arange(len(lens)), w.lens)
    out = []
    for hashes, end in zip((w.hashes, w.other_hashes), END):
        h = np.full(int(lens.sum()), end, _U)
        h[at] = hashes
        out.append(h)
    return *out, lens


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT


# ---- packed counts through the shuffle ------------------------------------------------------

_PACKED = "shard int, n long, keys binary, counts binary, codes binary"


def _pack(shard: int, keys: np.ndarray, counts: np.ndarray, codes: np.ndarray | None = None) -> tuple:
    """Sorted keys as differences, byte plane by byte plane, compressed."""
    z = lambda a: pa.compress(np.ascontiguousarray(a).tobytes(), codec="zstd", asbytes=True)
    planes = np.diff(keys, prepend=_U(0)).view(np.uint8).reshape(-1, 8).T
    return shard, len(keys), z(planes), z(counts.astype(np.uint32).view(np.uint8).reshape(-1, 4).T), b"" if codes is None else z(codes)


def _unpack(n: int, keys: bytes, counts: bytes, codes: bytes) -> tuple:
    un = lambda b, size: np.frombuffer(pa.decompress(b, size, codec="zstd", asbytes=True), np.uint8)
    k = np.cumsum(np.ascontiguousarray(un(keys, 8 * n).reshape(8, n).T).view(_U).ravel(), dtype=_U)
    c = np.ascontiguousarray(un(counts, 4 * n).reshape(4, n).T).view(np.uint32).ravel()
    return k, c, un(codes, n) if codes else None


def _packed_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, types)], ["shard", "n", "keys", "counts", "codes"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray | None]]:
    """The sums over all of a shard's packed rows; a partition holds whole shards."""
    held: dict[int, list] = {}

    def add(parts):
        k, c, codes = (None if xs[0] is None else np.concatenate(xs) for xs in zip(*parts))
        parts.clear()  # so that they don't stand beside the sorted arrays
        order = np.argsort(k, kind="stable")
        k = k[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        return k[first], np.add.reduceat(c[order], first, dtype=np.int64), None if codes is None else codes[order[first]]

    for b in batches:
        for shard, n, keys, counts, codes in zip(*(b.column(i).to_pylist() for i in range(5))):
            own = held.setdefault(shard, [])
            own.append(_unpack(n, keys, counts, codes))
            if len(own) > 1 and sum(len(p[0]) for p in own[1:]) > max(1_000_000, len(own[0][0])):
                held[shard] = [add(own)]
    while held:
        shard, own = held.popitem()
        yield shard, *add(own)


def _grouped(by: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value with its places, in one sort however many values there are."""
    if len(by):
        order = np.argsort(by, kind="stable")
        first = np.flatnonzero(np.diff(by[order], prepend=by[order[0]] - 1))
        for mine in np.split(order, first[1:]):
            yield int(by[mine[0]]), mine


# ---- the model ------------------------------------------------------------------------------


class Trie:
    """The levels in a shared folder.

    Words are numbered in the order of their hashes; a shard holds the words whose hash has its
    leading bits.  Level two holds a word's successors as monotone values word * V + successor and
    a monotone pointer to each word's first.  Level three holds, under each node of level two, the
    next word not by its number but by its place among the successors of the node's last word
    (found on level two), as monotone values node * U + place.  Probabilities are 8-bit steps of
    their logarithm, back-off weights too.
    """

    def __init__(self, folder: str, bits: int, offsets: np.ndarray, n: int, v: int, sizes: list[int] | None = None, successors: int = 1):
        self.folder, self.bits, self.offsets, self.n, self.v = folder, bits, offsets, n, v
        self.sizes, self.successors = sizes, successors
        self.floor = np.log10(1.0 / (n + v + 1)) - 0.5
        self.files: dict = {}
        self.absent: set[str] = set()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("files", "absent")}

    def __setstate__(self, state):
        self.__dict__.update(state, files={}, absent=set())

    def file(self, name: str, ef: bool = False):
        if name not in self.files:
            self.files[name] = EliasFano.open(self.folder, name) if ef else load(self.folder, name)
        return self.files[name]

    def holds(self, name: str) -> bool:
        if name not in self.files and name not in self.absent and not exists(self.folder, name):
            self.absent.add(name)
        return name not in self.absent

    def code(self, log_p: np.ndarray) -> np.ndarray:
        return np.rint(np.clip(log_p / self.floor, 0, 1) * 255).astype(np.uint8)

    def value(self, code: np.ndarray) -> np.ndarray:
        return code * (self.floor / 255)

    # words

    def numbers(self, h: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Word numbers of tokens, -1 for unknown words; each different word is looked up once."""
        _, first, back = np.unique(h, return_index=True, return_inverse=True)
        if (other[first][back] != other).any():  # two words that share their first hash
            return self.lookup(h, other)
        return self.lookup(h[first], other[first])[back]

    def lookup(self, h: np.ndarray, other: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        for s, mine in _grouped((h >> _U(64 - self.bits)).astype(np.int64)):
            own, second = self.file(f"words-{s}"), self.file(f"others-{s}")
            at = np.searchsorted(own, h[mine])
            left = np.flatnonzero(at < len(own))
            while len(left):  # words that share their first hash stand side by side
                k = at[left]
                here = own[k] == h[mine[left]]
                hit = here & (second[k] == other[mine[left]])
                out[mine[left[hit]]] = k[hit] + self.offsets[s]
                left = left[here & ~hit]
                at[left] += 1
                left = left[at[left] < len(own)]
        return out

    def shard_of(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, word, side="right") - 1

    def _by_shard(self, word: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        return _grouped(self.shard_of(word))

    def counts(self, word: np.ndarray) -> np.ndarray:
        out = np.zeros(len(word), np.int64)
        ok = np.flatnonzero(word >= 0)
        for s, mine in self._by_shard(word[ok]):
            out[ok[mine]] = self.file(f"counts-{s}")[word[ok[mine]] - self.offsets[s]]
        return out

    def log_unigram(self, word: np.ndarray) -> np.ndarray:
        return np.log10((self.counts(word) + 1) / (self.n + self.v + 1))

    # levels

    def pairs(self, first: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each pair of word numbers: its shard, its node there (or -1), the node's code and the
        place of ``word`` among the successors of ``first``.  The pairs must be known words."""
        node, code, place = np.full(len(word), -1, np.int64), np.zeros(len(word), np.uint8), np.zeros(len(word), np.int64)
        shard = self.shard_of(first)
        for s, mine in self._by_shard(first):
            local = first[mine] - self.offsets[s]
            at = self.file(f"two-{s}", True).find(local.astype(_U) * _U(self.v) + word[mine].astype(_U))
            hit = np.flatnonzero(at >= 0)
            node[mine] = at
            code[mine[hit]] = self.file(f"two-p-{s}")[at[hit]]
            place[mine[hit]] = at[hit] - self.file(f"two-at-{s}", True).get(local[hit]).astype(np.int64)
        return shard, node, code, place

    def back_off(self, word: np.ndarray) -> np.ndarray:
        out = np.zeros(len(word))
        for s, mine in self._by_shard(word):
            out[mine] = self.value(self.file(f"two-b-{s}")[word[mine] - self.offsets[s]])
        return out

    def part_of(self, shard: np.ndarray, node: np.ndarray) -> np.ndarray:
        first = np.concatenate([[0], np.cumsum([-(-n // PART_NODES) for n in self.sizes])])
        return first[shard] + node // PART_NODES

    def parts(self) -> int:
        return sum(-(-n // PART_NODES) for n in self.sizes)

    def triples(self, shard: np.ndarray, node: np.ndarray, place: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 P of (node, place) where level three holds it, else nan; and the node's back-off."""
        log_p, back = np.full(len(node), np.nan), np.zeros(len(node))
        for k, mine in _grouped(self.part_of(shard, node)):
            local = node[mine] % PART_NODES
            if not self.holds(f"three-b-{k}"):
                continue
            back[mine] = self.value(self.file(f"three-b-{k}")[local])
            q = np.flatnonzero(asked[mine])
            at = self.file(f"three-{k}", True).find(local[q].astype(_U) * _U(self.successors) + place[mine[q]].astype(_U))
            hit = q[at >= 0]
            log_p[mine[hit]] = self.value(self.file(f"three-p-{k}")[at[at >= 0]])
        return log_p, back


class Tokens:
    """Word numbers of texts (of ``lens`` tokens each) with, for each token, the two before it."""

    def __init__(self, trie: Trie, word: np.ndarray, lens: np.ndarray):
        self.off = np.concatenate([[0], np.cumsum(lens)])
        self.word = word
        self.place = np.arange(len(self.word)) - np.repeat(self.off[:-1], lens)
        end = int(trie.lookup(*(np.array([x]) for x in END))[0])
        self.prev = np.where(self.place > 0, np.roll(self.word, 1), end)  # a text follows the last one's end

    def nodes(self, trie: Trie):
        """Shard, node, code and place of each (previous word, word); node -1 where unseen."""
        known = np.flatnonzero((self.word >= 0) & (self.prev >= 0))
        keys, back = np.unique(self.prev[known].astype(_U) * _U(trie.v) + self.word[known].astype(_U), return_inverse=True)
        got = trie.pairs((keys // _U(trie.v)).astype(np.int64), (keys % _U(trie.v)).astype(np.int64))
        out = [np.zeros(len(self.word), np.int64), np.full(len(self.word), -1, np.int64), np.zeros(len(self.word), np.uint8), np.zeros(len(self.word), np.int64)]
        for a, g in zip(out, got):
            a[known] = g[back]
        return out

    def contexts(self, shard: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shard and node of the two words before each token; -1 for a text's first."""
        return np.roll(shard, 1), np.where(self.place > 0, np.roll(node, 1), -1)


def scores(trie: Trie, word: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, ...]:
    """Tokens, known tokens, base score and model score of each text."""
    t = Tokens(trie, word, lens)
    uni = trie.log_unigram(t.word)
    shard, node, code, place = t.nodes(trie)
    log_p = trie.value(code)
    unseen = np.flatnonzero(node < 0)
    log_p[unseen] = uni[unseen]
    ctx = unseen[t.prev[unseen] >= 0]
    log_p[ctx] += trie.back_off(t.prev[ctx])
    up_shard, up = t.contexts(shard, node)
    have = np.flatnonzero(up >= 0)
    got, back = trie.triples(up_shard[have], up[have], place[have], node[have] >= 0)
    log_p[have] = np.where(np.isnan(got), log_p[have] + back, got)
    sums = lambda x: np.add.reduceat(x, t.off[:-1]) if len(lens) else np.empty(0)
    return np.diff(t.off), sums((t.word >= 0).astype(np.int64)), sums(uni), sums(log_p)


# ---- word numbers, looked up once for all later passes --------------------------------------

_NUMBERED = "train boolean, ids array<long>, lens array<long>, numbers binary"
#: Small row groups: a reader's batch holds a whole one.
_SMALL_GROUPS = {"parquet.block.size": 16 << 20}


def numbered(docs: DataFrame, trie: Trie, train=None) -> DataFrame:
    """Blocks of documents as word numbers, those to learn from (where ``train`` holds, or all) apart from the rest."""
    shared = docs.sparkSession.sparkContext.broadcast(trie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tr = shared.value
        width = _width(tr)
        for b in slices(batches):
            h, other, lens = tokens(b.column(1))
            word, off = tr.numbers(h, other), np.concatenate([[0], np.cumsum(lens)])
            learn = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for flag in (True, False):
                own = np.flatnonzero(learn == flag)
                part = (np.cumsum(lens[own]) - lens[own]) // BLOCK
                for rows in np.split(own, np.flatnonzero(np.diff(part)) + 1) if len(own) else ():
                    mine = spans(word, off[rows], lens[rows]).astype(f"i{width}")
                    planes = np.ascontiguousarray(mine.view(np.uint8).reshape(-1, width).T)
                    z = pa.compress(planes.tobytes(), codec="zstd", asbytes=True)
                    ids = b.column(0).take(pa.array(rows)).to_pylist()
                    yield pa.RecordBatch.from_arrays([pa.array([flag]), pa.array([ids], pa.list_(pa.int64())), pa.array([lens[rows].tolist()], pa.list_(pa.int64())), pa.array([z], pa.binary())], ["train", "ids", "lens", "numbers"])

    flagged = documents(docs).select("doc_id", "text", (F.lit(True) if train is None else F.coalesce(train, F.lit(False))).alias("train"))
    return flagged.mapInArrow(run, _NUMBERED)


def _width(trie: Trie) -> int:
    """Bytes of a word number."""
    return 4 if trie.v < 1 << 31 else 8


def _blocks(batches: Iterator[pa.RecordBatch], trie: Trie, limit: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Ids, word numbers and lengths of runs of documents of about ``limit`` tokens, from ``numbered`` rows."""
    width, ids, words, lens, n = _width(trie), [], [], [], 0
    for b in batches:
        for at in range(b.num_rows):
            own = np.array(b.column(2)[at].as_py(), np.int64)
            m = int(own.sum())
            raw = np.frombuffer(pa.decompress(b.column(3)[at].as_py(), m * width, codec="zstd", asbytes=True), np.uint8)
            words.append(np.ascontiguousarray(raw.reshape(width, m).T).view(f"i{width}").ravel().astype(np.int64))
            ids += b.column(1)[at].as_py()
            lens.append(own)
            n += m
            if n >= limit:
                yield ids, np.concatenate(words), np.concatenate(lens)
                ids, words, lens, n = [], [], [], 0
    if ids:
        yield ids, np.concatenate(words), np.concatenate(lens)


def _vocabulary(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, int, int]:
    """(h, other, c) of all words; their number and sum."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def sums() -> pa.RecordBatch:
            h, other = (np.concatenate(x) for x in zip(*held))
            by = np.argsort(h, kind="stable")
            new = np.concatenate([np.ones(1, bool), np.diff(h[by]) != 0])
            if (other[by][1:] != other[by][:-1])[~new[1:]].any():  # two words that share their first hash
                by = np.lexsort((other, h))
                new = np.concatenate([np.ones(1, bool), (np.diff(h[by]) != 0) | (np.diff(other[by]) != 0)])
            first = np.flatnonzero(new)
            c = np.diff(first, append=len(h))
            return pa.RecordBatch.from_arrays([pa.array(h[by][first].view(np.int64)), pa.array(other[by][first].view(np.int64)), pa.array(c)], ["h", "other", "c"])

        for b in slices(batches):
            h, other, _ = tokens(b.column(1))
            held.append((h, other))
            n += len(h)
            if n >= COUNTED:
                yield sums()
                held, n = [], 0
        if n:
            yield sums()

    vocab = scratch.keep(docs.mapInArrow(count, "h long, other long, c long").groupBy("h", "other").agg(F.sum("c").alias("c")), "vocabulary")
    v, n = vocab.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    return vocab, v, n


def train(docs: DataFrame, scratch: Scratch) -> Trie:
    """The trie of ``docs`` (doc_id, text), built in shards by the executors."""
    words = first_level(docs, scratch)
    return upper_levels(scratch.keep(numbered(docs, words), "numbers", **_SMALL_GROUPS), words)


def first_level(docs: DataFrame, scratch: Scratch) -> Trie:
    """A trie of words alone."""
    vocab, v, n = _vocabulary(docs, scratch)
    bits = max(1, int(np.ceil(np.log2(max(n / SHARD_TOKENS, 2)))))
    shards, folder = 1 << bits, scratch.folder("trie")
    top = F.shiftrightunsigned("h", 64 - bits).cast("int")
    per = dict(map(tuple, vocab.groupBy(top.alias("s")).count().collect()))  # one row for each shard
    offsets = np.concatenate([[0], np.cumsum([per.get(s, 0) for s in range(shards)])])[:-1].astype(np.int64)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(b.column(0).to_numpy(), b.column(1).to_numpy().view(_U), b.column(2).to_numpy().view(_U), b.column(3).to_numpy()) for b in batches]
        if rows:
            s, h, other, c = map(np.concatenate, zip(*rows))
            for k, mine in _grouped(s):
                mine = mine[np.lexsort((other[mine], h[mine]))]
                save(folder, f"words-{k}", h[mine])
                save(folder, f"others-{k}", other[mine])
                save(folder, f"counts-{k}", c[mine])
        yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int32())], ["n"])

    vocab.select(top.alias("s"), "h", "other", "c").repartitionById(shards, F.col("s")).mapInArrow(words, "n int").collect()
    for s in range(shards):
        if s not in per:
            save(folder, f"words-{s}", np.empty(0, _U))
            save(folder, f"others-{s}", np.empty(0, _U))
            save(folder, f"counts-{s}", np.empty(0, np.int64))
    return Trie(folder, bits, offsets, n, v)


def upper_levels(blocks: DataFrame, trie: Trie) -> Trie:
    """``trie`` with levels two and three, of what ``numbered`` made of its texts."""
    folder, bits, offsets, n, v = trie.folder, trie.bits, trie.offsets, trie.n, trie.v
    shards, sc = 1 << bits, blocks.sparkSession.sparkContext
    per = {s: int(b - a) for s, (a, b) in enumerate(zip(offsets, [*offsets[1:], v]))}

    # level two
    shared = sc.broadcast(trie)

    def pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tr = shared.value
        for _, word, lens in _blocks(batches, tr, GATHER):
            t = Tokens(tr, word, lens)
            keys, c = np.unique(t.prev.astype(_U) * _U(tr.v) + t.word.astype(_U), return_counts=True)
            shard = tr.shard_of((keys // _U(tr.v)).astype(np.int64))
            cuts = np.searchsorted(shard, np.arange(shards + 1))
            yield _packed_batch([_pack(s, keys[a:b], c[a:b]) for s, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b])

    def build_two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tr, done = shared.value, []
        for s, keys, c, _ in _merged(batches):
            own = len(tr.file(f"words-{s}"))
            first = (keys // _U(tr.v)).astype(np.int64) - tr.offsets[s]
            many = np.bincount(first, minlength=own)
            total = np.bincount(first, weights=c, minlength=own)
            uni = 10 ** tr.log_unigram((keys % _U(tr.v)).astype(np.int64))
            back = DISCOUNT * many / np.maximum(total, 1)
            p = np.maximum(c - DISCOUNT, 0) / total[first] + back[first] * uni
            EliasFano.build(keys - _U(tr.offsets[s] * tr.v), own * tr.v + 1).store(tr.folder, f"two-{s}")
            save(tr.folder, f"two-p-{s}", tr.code(np.log10(p)))
            save(tr.folder, f"two-b-{s}", tr.code(np.where(many > 0, np.log10(np.where(many > 0, back, 1)), 0)))
            EliasFano.build(np.concatenate([[0], np.cumsum(many)]), len(keys) + 1).store(tr.folder, f"two-at-{s}")
            done.append((s, len(keys), int(many.max(initial=0))))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*done) if done else [()] * 3)], ["s", "n", "most"])

    got = blocks.mapInArrow(pair_counts, _PACKED).repartitionById(shards, F.col("shard")).mapInArrow(build_two, "s long, n long, most long").collect()
    size = {r[0]: r[1] for r in got}
    for s in set(range(shards)) - set(size):
        own = per.get(s, 0)
        EliasFano.build(np.empty(0, _U), own * v + 1).store(folder, f"two-{s}")
        EliasFano.build(np.zeros(own + 1, _U), 1).store(folder, f"two-at-{s}")
        save(folder, f"two-p-{s}", np.empty(0, np.uint8))
        save(folder, f"two-b-{s}", np.zeros(own, np.uint8))

    # level three
    trie = Trie(folder, bits, offsets, n, v, [size.get(s, 0) for s in range(shards)], max([r[2] for r in got], default=0) + 1)
    shared3 = sc.broadcast(trie)

    def triple_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tr = shared3.value
        for _, word, lens in _blocks(batches, tr, GATHER):
            t = Tokens(tr, word, lens)
            shard, node, code, place = t.nodes(tr)
            up_shard, up = t.contexts(shard, node)
            have = np.flatnonzero(up >= 0)
            part = tr.part_of(up_shard[have], up[have])
            key = (up[have] % PART_NODES).astype(_U) * _U(tr.successors) + place[have].astype(_U)
            order = np.lexsort((key, part))
            part, key, code = part[order], key[order], code[have][order]
            first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])])) if len(key) else np.empty(0, np.int64)
            c = np.diff(first, append=len(key))
            cuts = np.searchsorted(part[first], np.arange(tr.parts() + 1))
            yield _packed_batch([_pack(k, key[first[a:b]], c[a:b], code[first[a:b]]) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b])

    def build_three(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tr, done = shared3.value, 0
        for k, keys, c, codes in _merged(batches):
            node = (keys // _U(tr.successors)).astype(np.int64)
            many = np.bincount(node, minlength=PART_NODES)
            total = np.bincount(node, weights=c, minlength=PART_NODES)
            back = DISCOUNT * many / np.maximum(total, 1)
            p = np.maximum(c - DISCOUNT, 0) / total[node] + back[node] * 10 ** tr.value(codes)
            EliasFano.build(keys, PART_NODES * tr.successors + 1).store(tr.folder, f"three-{k}")
            save(tr.folder, f"three-p-{k}", tr.code(np.log10(p)))
            save(tr.folder, f"three-b-{k}", tr.code(np.where(many > 0, np.log10(np.where(many > 0, back, 1)), 0)))
            done += 1
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int32())], ["n"])

    if trie.parts():
        blocks.mapInArrow(triple_counts, _PACKED).repartitionById(trie.parts(), F.col("shard")).mapInArrow(build_three, "n int").collect()
    return trie


def score(docs: DataFrame, trie: Trie) -> DataFrame:
    """Each row's doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    A null text counts as empty (its end alone); repeated rows are scored each; a null doc_id
    belongs to neither part (held_out null).
    """
    return score_numbered(numbered(docs, trie), trie)


def score_numbered(blocks: DataFrame, trie: Trie) -> DataFrame:
    """``score`` of what ``numbered`` made of the texts."""
    shared = blocks.sparkSession.sparkContext.broadcast(trie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tr = shared.value
        for ids, word, lens in _blocks(batches, tr, GATHER // 3):
            n, known, base, own = scores(tr, word, lens)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n), pa.array(known), pa.array(base), pa.array(own)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    got = blocks.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return got.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(trie.n).cast("long").alias("train_tokens"), "base_score", "score")


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = documents(table(spark, sf_dir, "documents")), Scratch(spark, "lm")
    words = first_level(docs.where(~held_out()), scratch)
    blocks = scratch.keep(numbered(docs, words, ~held_out()), "numbers", **_SMALL_GROUPS)
    return score_numbered(blocks, upper_levels(blocks.where("train"), words))
