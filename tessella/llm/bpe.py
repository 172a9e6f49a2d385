"""Token counts and byte-pair encoding that reuse what has been merged before."""

from __future__ import annotations

import hashlib
import math
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, documents, runs
from tessella.llm.elias_fano import load, save
from tessella.llm.words import mix, powers, slices, spans

#: Pre-tokens or chunks that a worker keeps; a bound on memory only, results are the same without.
CACHED = 150_000
OVER = 2048

# The split patterns that the two vocabulary files state.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters on whose class and lower case every library and Unicode version agrees, and which no
#: normal form changes.  Texts with others are parted by the library's own normaliser and pre-tokeniser,
#: which take longer, and then go the same way; special tokens' strings are cut out first.
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-¬®-įı-ž]*")
_CLASSES = {r"\p{L}": "A-Za-zªµºÀ-ÖØ-öø-ž", r"\p{N}": "0-9²³¹¼-¾"}


def _plain_split(pattern: str):
    """The pattern with its classes spelt out for plain texts."""
    for name, chars in _CLASSES.items():
        pattern = pattern.replace(f"[{name}]", f"[{chars}]").replace(f" ?{name}", f" ?[{chars}]").replace(name, chars)
    return re.compile(pattern)


def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _encode(t, texts: list[str]) -> list[list[int]]:
    """Lone surrogates cannot be encoded and count as U+FFFD."""
    return [e.ids for e in t.encode_batch_fast([x.encode("utf-8", "replace").decode() if not x.isascii() and _lone(x) else x for x in texts], add_special_tokens=False)]


def _lone(x: str) -> bool:
    return re.search("[\ud800-\udfff]", x) is not None


def _plain(text: str) -> bool:
    return _PLAIN.fullmatch(text) is not None


def _specials(library) -> tuple[re.Pattern, dict[str, int]]:
    ids = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
    return re.compile("(" + "|".join(map(re.escape, sorted(ids, key=len, reverse=True))) + ")"), ids


# ---- counts ---------------------------------------------------------------------------------


def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings proved, by the library itself, to be one pre-token and one token when they stand alone."""
    t = _library(path)
    byte_of = {v: k for k, v in _byte_alphabet().items()}
    strings = []
    for v in t.get_vocab():
        try:
            strings.append(bytes(byte_of[c] for c in v.removesuffix("</w>")).decode() if v.endswith("</w>") else "")
        except (KeyError, UnicodeDecodeError):
            continue
    alone = [s for s in strings if s and t.normalizer.normalize_str(s) == s and len(t.pre_tokenizer.pre_tokenize_str(s)) == 1]
    return frozenset(s for s, ids in zip(alone, _encode(t, alone)) if len(ids) == 1)


def _byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class TokenCounter:
    def __init__(self, path: str, whole: frozenset[str]):
        self.library, self.split = _library(path), _plain_split(WORD_SPLIT).findall
        self.special, self.special_ids = _specials(self.library)
        self.ends = np.array([v.endswith("</w>") for v, _ in sorted(self.library.get_vocab().items(), key=lambda x: x[1])])
        self.back = {v: k for k, v in _byte_alphabet().items()}
        self.whole = len(whole)
        self.count = dict.fromkeys(whole, 1)

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text that holds no special token's string."""
        if _plain(text):
            return self.split(text.lower())
        if _lone(text):
            text = text.encode("utf-8", "replace").decode()
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.back.__getitem__, w)).decode() for w, _ in found]

    def counts(self, texts: list[str]) -> list[int]:
        out, later = [0] * len(texts), []
        for i, t in enumerate(texts):
            if "<|" in t and (parts := self.special.split(t))[1:]:
                out[i] = len(parts) // 2
                words = [w for part in parts[::2] for w in self.words(part)]
            else:
                words = self.words(t)
            try:
                out[i] += sum(map(self.count.__getitem__, words))
            except KeyError:
                later.append((i, words))
        if later:
            if len(self.count) > self.whole + CACHED:
                self.count = dict(list(self.count.items())[: self.whole])
            missing = list({w for _, words in later for w in words}.difference(self.count))
            self.count.update(zip(missing, self._merged(missing)))
            for i, words in later:
                out[i] += sum(map(self.count.__getitem__, words))
        return out

    def _merged(self, words: list[str]) -> list[int]:
        """Tokens of each word; all are merged in one call, parted where a token ends a word."""
        last = np.flatnonzero(self.ends[np.array(_encode(self.library, [" ".join(words)])[0], np.int64)])
        if len(last) != len(words):  # a word that does not stand for itself among others
            return [len(ids) for ids in _encode(self.library, words)]
        return np.diff(last, prepend=-1).tolist()


_COUNTERS: dict[str, TokenCounter] = {}


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row; a null text counts as empty."""
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))  # bounded by the vocabulary

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _COUNTERS:
            _COUNTERS[path] = TokenCounter(path, whole.value)
        for ids, texts in runs(batches):
            n = _COUNTERS[path].counts(texts)
            size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > OVER for x in n])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return documents(docs).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessella.llm.common import table

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


# ---- encoding -------------------------------------------------------------------------------

#: A boundary every 512 bytes on average, where a hash of the last _ROLL bytes has its low bits zero.
_CHUNK_MASK, _ROLL = np.uint64(0x1FF), 16
#: Pre-tokens at a chunk's start after each of which its stored ids may be taken up.
_OPENING = 8
#: Chunks for each shard of the table of shared ones; one task holds a shard, some 50 MB.
SHARD_CHUNKS = 50_000
#: Bytes from which a pre-token is merged by the library, whose time does not grow with their square.
LONG = 400
_ROLL_UP = powers(0xD6E8FEB86659FD93, 1 << 16)
_ROLL_BYTE = mix(np.arange(301, 557, dtype=np.uint64))


def chunk_bounds(raw: np.ndarray) -> np.ndarray:
    """Content-defined boundaries in UTF-8 bytes (the ends included): before a character that follows
    _ROLL bytes of which a hash has its low bits zero."""
    n, found = len(raw), [np.zeros(1, np.int64)]
    step = len(_ROLL_UP) - _ROLL - 1
    for at in range(0, max(n - _ROLL, 0), step):
        part = raw[at : at + step + _ROLL]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_ROLL_BYTE[part] * _ROLL_UP[: len(part)], out=sums[1:])
        h = (sums[_ROLL:] - sums[:-_ROLL]) * _ROLL_UP[len(_ROLL_UP) - 1 - np.arange(len(sums) - _ROLL)]
        found.append(np.flatnonzero((mix(h) & _CHUNK_MASK) == 0) + at + _ROLL)
    cut = np.concatenate(found)
    cut = cut[cut < n]
    cut = cut[(raw[cut] & 0xC0) != 0x80]
    return np.unique(np.append(cut, n))


def _chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Two hashes of each chunk of all texts, and each text's bounds."""
    bounds = [chunk_bounds(np.frombuffer(t, np.uint8)) for t in texts]
    pieces = [t[s:e] for t, b in zip(texts, bounds) for s, e in zip(b.tolist(), b[1:].tolist())]
    hashes = np.array([xxhash.xxh3_128_digest(x) for x in pieces], "S16").tobytes().ljust(16 * len(pieces), b"\0")
    pair = np.frombuffer(hashes, np.uint64).reshape(-1, 2)
    return pair[:, 0], pair[:, 1], bounds


def _sure(pieces: list[str]) -> int:
    """How many pre-tokens of a piece of text stay what they are whatever follows it."""
    n = len(pieces) - 1
    return n - 1 if n > 0 and pieces[-2] == "'" and pieces[-1] in ("r", "v", "l") else max(n, 0)


class Encoder:
    """Encodes texts chunk by chunk; what chunks give alone is mended at their joins.

    Of a chunk encoded alone all pre-tokens but the last (the last two, if they may become one short
    form like 'll) are what they would be before any other text.  At a join the last of what stands
    before is parted anew together with the chunk, pre-token by pre-token, until one ends where one
    of the chunk's own does: what follows depends on what follows only, so from there on the chunk's
    ids are exactly those of the whole text.  If none does, more chunks are taken in, twice as many
    each time.
    """

    def __init__(self, path: str):
        self.library = _library(path)
        self.pattern = _plain_split(BYTE_SPLIT)
        self.special, self.special_ids = _specials(self.library)
        self.words: dict[str, bytes] = {}
        back = {v: k for k, v in _byte_alphabet().items()}
        vocab = self.library.get_vocab()
        bytes_of = {i: v.encode() if v in self.special_ids else bytes(back[c] for c in v) for v, i in vocab.items()}
        every = [bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)]
        self.token_size = np.array(list(map(len, every)), np.int64)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(every), np.uint8)

        ranks = {v: i for i, v in bytes_of.items() if i not in self.special_ids.values()}
        # The merges of a byte-level vocabulary in order of id are ranks; one pre-token is merged alone.
        self.merge = tiktoken.Encoding("ranks", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text without special tokens' strings."""
        if _plain(text):
            return self.pattern.findall(text)
        return [text[s:e] for _, (s, e) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def ids(self, pieces: list[str]) -> bytes:
        """Ids of pre-tokens as little-endian unsigned 32-bit integers."""
        w = self.words
        try:
            return b"".join(map(w.__getitem__, pieces))
        except KeyError:
            if len(w) > CACHED:
                w.clear()
            for p in pieces:
                if p not in w:
                    own = self.merge(p) if len(p) < LONG else _encode(self.library, [p])[0]
                    w[p] = np.array(own, "<u4").tobytes()
            return b"".join(map(w.__getitem__, pieces))

    def chunk(self, chunk: str) -> tuple[bytes, list[tuple[int, int]], str]:
        """Of a chunk alone: the ids of all pre-tokens but the last, after how many characters and bytes
        of ids its first ones end, and the last one."""
        pieces = self.split(chunk)
        sure = _sure(pieces)
        opening, at, n = [(0, 0)], 0, 0
        for p in pieces[: min(_OPENING, sure)]:
            at, n = at + len(p), n + len(self.ids([p]))
            opening.append((at, n))
        return self.ids(pieces[:sure]), opening, "".join(pieces[sure:])

    def _joined(self, chunks: list[str], known: list) -> bytes:
        out, left, k, take = [], "", 0, 1
        while k < len(chunks):
            own = known[k] or (self.chunk(chunks[k]) if take == 1 else None)
            if own is not None and take == 1:
                core, opening, last = own
                ends = dict(opening)
                at, met = -len(left), 0 if not left else None
                if left:
                    some = self.split(left + chunks[k][: opening[-1][0] + 64])
                    pieces = []
                    for p in some[: _sure(some)]:
                        at += len(p)
                        pieces.append(p)
                        if at in ends:
                            met = at
                            break
                    if met is not None:
                        out.append(self.ids(pieces))
                if met is not None:
                    out.append(core[ends[met] :])
                    left, k = last, k + 1
                    continue
            pieces = self.split(left + "".join(chunks[k : k + take]))
            sure = _sure(pieces)
            out.append(self.ids(pieces[:sure]))
            left, k = "".join(pieces[sure:]), k + take
            take = 1 if sure else 2 * take
        out.append(self.ids(self.split(left)) if left else b"")
        return b"".join(out)

    def encode(self, text: str, bounds: np.ndarray | None = None, known: list | None = None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; ``known`` has what some of its chunks give alone."""
        raw = text.encode("utf-8", "replace")
        if bounds is None:
            bounds = chunk_bounds(np.frombuffer(raw, np.uint8))
        if "<|" in text and self.special.search(text):  # bounds may lie in a special token's string
            parts = self.special.split(text)
            inner = [self.encode(p) if k % 2 == 0 else np.array([self.special_ids[p]], "<u4").tobytes() for k, p in enumerate(parts)]
            return b"".join(inner)
        at = bounds.tolist()
        chunks = [raw[s:e].decode() for s, e in zip(at, at[1:])]
        return self._joined(chunks, known or [None] * len(chunks))

    def decode(self, ids: bytes) -> bytes:
        i = np.frombuffer(ids, "<u4").astype(np.int64)
        return spans(self.token_bytes, self.token_start[i], self.token_size[i]).tobytes().decode("utf-8", "replace").encode()


class Shared:
    """The chunks that stand at two places or more, in shards of the shared folder by their hash: two
    hashes each, the place whose task encodes it, and then what it gives alone."""

    def __init__(self, folder: str, bits: int):
        self.folder, self.bits, self.files = folder, bits, {}

    def __getstate__(self):
        return {"folder": self.folder, "bits": self.bits, "files": {}}

    def file(self, name: str):
        if name not in self.files:
            self.files[name] = load(self.folder, name)
        return self.files[name]

    def shard(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shard and row of each chunk, row -1 if it is not shared."""
        shard, row = self.shard(h1), np.full(len(h1), -1, np.int64)
        for s in np.unique(shard):
            own, other = self.file(f"h1-{s}"), self.file(f"h2-{s}")
            mine = np.flatnonzero(shard == s)
            at = np.searchsorted(own, h1[mine])
            inside = np.flatnonzero(at < len(own))
            while len(inside):  # rows of the same first hash stand side by side
                k = at[inside]
                here = own[k] == h1[mine[inside]]
                hit = here & (other[k] == h2[mine[inside]])
                row[mine[inside[hit]]] = k[hit]
                inside = inside[here & ~hit]
                at[inside] += 1
                inside = inside[at[inside] < len(own)]
        return shard, row

    def owner(self, shard: np.ndarray, row: np.ndarray) -> np.ndarray:
        return np.array([self.file(f"place-{s}")[r] if r >= 0 else 0 for s, r in zip(shard.tolist(), row.tolist())], np.int64)

    def known(self, shard: int, row: int) -> tuple[bytes, list[tuple[int, int]], str] | None:
        if row < 0:
            return None
        off = self.file(f"off-{shard}")
        record = self.file(f"records-{shard}")[off[row] : off[row + 1]].tobytes()
        n = record[0]
        opening = np.frombuffer(record, "<u4", 2 * n, 1).reshape(-1, 2).tolist()
        last = int.from_bytes(record[1 + 8 * n : 5 + 8 * n], "little")
        return record[5 + 8 * n + last :], list(map(tuple, opening)), record[5 + 8 * n : 5 + 8 * n + last].decode()


def _record(core: bytes, opening: list[tuple[int, int]], last: str) -> bytes:
    raw = last.encode()
    return bytes([len(opening)]) + np.array(opening, "<u4").tobytes() + len(raw).to_bytes(4, "little") + raw + core


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _looked_up(b: pa.RecordBatch, shared: Shared | None):
    """Bytes and bounds of a batch's texts, and hashes, shards and rows of their chunks, text after text."""
    texts = [x.encode("utf-8", "replace") if x else b"" for x in b.column(1).to_pylist()]
    h1, h2, bounds = _chunks(texts)
    shard, row = shared.find(h1, h2) if shared else (np.zeros(len(h1), np.int64), np.full(len(h1), -1))
    return texts, bounds, h1, h2, shard, row


def _places(seed: np.ndarray, bounds: list[np.ndarray]) -> np.ndarray:
    n = np.array([len(b) - 1 for b in bounds], np.int64)
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return mix(np.repeat(seed.view(np.uint64), n) + within.astype(np.uint64)).view(np.int64)


def shared_chunks(docs: DataFrame, path: str, scratch: Scratch) -> Shared | None:
    """The table of the chunks of ``docs`` (doc_id, text, seed) that stand at two places, each encoded once,
    by the task that holds the least place; None if there are none.  No text is shuffled."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            _, bounds, h1, h2, _, _ = _looked_up(b, None)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (h1, h2)] + [pa.array(_places(b.column(2).to_numpy(), bounds))], ["h1", "h2", "place"])

    counted = docs.mapInArrow(places, "h1 long, h2 long, place long").groupBy("h1", "h2").agg(F.min("place").alias("place"), F.max("place").alias("other"))
    often = scratch.keep(counted.where("place <> other").select("h1", "h2", "place"), "shared")
    n = often.count()
    if not n:
        return None
    bits = max(1, math.ceil(math.log2(max(n / SHARD_CHUNKS, 2))))
    table_ = Shared(scratch.folder("chunks"), bits)
    shard = F.shiftrightunsigned("h1", 64 - bits).cast("int")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if rows:
            s, h1, h2, place = (np.concatenate([b.column(k).to_numpy() for b in rows]) for k in range(4))
            by = np.lexsort((h2.view(np.uint64), h1.view(np.uint64), s))
            s, h1, h2, place = s[by], h1[by], h2[by], place[by]
            for k in np.unique(s):
                for name, x in (("h1", h1.view(np.uint64)), ("h2", h2.view(np.uint64)), ("place", place)):
                    save(table_.folder, f"{name}-{k}", x[s == k])
        yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int32())], ["n"])

    often.select(shard.alias("s"), "h1", "h2", "place").repartitionById(1 << bits, F.col("s")).mapInArrow(keys, "n int").collect()
    held = {r[0] for r in often.select(shard).distinct().collect()}  # one row for each shard
    for k in set(range(1 << bits)) - held:
        for name, kind in (("h1", np.uint64), ("h2", np.uint64), ("place", np.int64), ("records", np.uint8)):
            save(table_.folder, f"{name}-{k}", np.empty(0, kind))
        save(table_.folder, f"off-{k}", np.zeros(1, np.int64))

    def encode_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        for b in slices(batches):
            texts, bounds, _, _, shard, row = _looked_up(b, table_)
            mine = (row >= 0) & (table_.owner(shard, row) == _places(b.column(2).to_numpy(), bounds))
            pieces = [(t, s, e) for t, x in zip(texts, bounds) for s, e in zip(x.tolist(), x[1:].tolist())]
            found = np.flatnonzero(mine)
            records = [_record(*enc.chunk(t[s:e].decode())) for t, s, e in (pieces[k] for k in found.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(shard[found].astype(np.int32)), pa.array(row[found]), pa.array(records, pa.binary())], ["s", "row", "record"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, dict[int, bytes]] = {}
        for b in batches:
            for s, r, x in zip(*(b.column(k).to_pylist() for k in range(3))):
                own.setdefault(s, {})[r] = x
        for s, rows in own.items():
            parts = [rows[r] for r in range(len(load(table_.folder, f"h1-{s}")))]
            save(table_.folder, f"records-{s}", np.frombuffer(b"".join(parts), np.uint8))
            save(table_.folder, f"off-{s}", np.concatenate([[0], np.cumsum(list(map(len, parts)), dtype=np.int64)]))
        yield pa.RecordBatch.from_arrays([pa.array([len(own)], pa.int32())], ["n"])

    docs.mapInArrow(encode_own, "s int, row long, record binary").repartitionById(1 << bits, F.col("s")).mapInArrow(records, "n int").collect()
    return table_


def encode_documents(docs: DataFrame, path: str, scratch: Scratch, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and digests of ids and of the text decoded from them, for each row.

    Chunks that stand at two places of the corpus, whatever the documents, are encoded once and read by
    all tasks from a memory-mapped table; a text's other chunks are encoded with it.  A null text counts
    as empty (no ids); repeated rows give repeated rows; an empty table gives none; other columns,
    whatever their names, are not looked at.  ``with_ids`` adds the ids themselves (array of int).
    """
    docs = documents(docs)
    shared = shared_chunks(docs.where("text <> ''").withColumn("seed", F.xxhash64("doc_id", "text")), path, scratch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        for b in slices(batches):
            texts, bounds, _, _, shard, row = _looked_up(b, shared)
            codes, at, where = [], 0, list(zip(shard.tolist(), row.tolist()))
            for t, x in zip(texts, bounds):
                n = len(x) - 1
                known = [shared.known(*k) if k[1] >= 0 else None for k in where[at : at + n]] if shared else [None] * n
                codes.append(enc.encode(t.decode(), x, known))
                at += n
            cols = [
                b.column(0), pa.array([len(c) // 4 for c in codes], pa.int64()),
                pa.array([hashlib.sha256(c).hexdigest() for c in codes], pa.string()), pa.array([hashlib.sha256(enc.decode(c)).hexdigest() for c in codes], pa.string()),
            ]
            if with_ids:
                cols.append(pa.array([np.frombuffer(c, "<u4").astype(np.int32) for c in codes], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(cols)])

    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessella.llm.common import table

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), Scratch(spark, "bpe"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: the documents as token ids (``ids``), their number and digests."""
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), Scratch(spark, "bpe-stage"), with_ids=True)
