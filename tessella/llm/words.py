"""Words of whole Arrow columns as places and 64-bit hashes, without a Python object for each."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_U = np.uint64
M1, M2, M3 = (_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: Bytes of text that are looked at together (more only if one text is longer), and that are hashed in one go.
SLICE, SEGMENT = 4 << 20, 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * M1
    x = (x ^ (x >> _U(29))) * M2
    return x ^ (x >> _U(32))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[:1] = 1
    return np.multiply.accumulate(out)


_BASE = 0x9E3779B97F4A7C15
_UPS = [powers(base, SEGMENT + 1) for base in (_BASE, 0xD6E8FEB86659FD93)]
_BYTES = [mix(np.arange(first, first + 256, dtype=_U)) for first in (1, 1001)]
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_PUNCTUATION = _SPACES.copy()  # with what separates words once ASCII punctuation is left out
_PUNCTUATION[[c for c in range(128) if not chr(c).isalnum()]] = True


class Words:
    """The words of a column of texts; a null text has none.

    ``raw`` are the texts' UTF-8 bytes with A-Z in lower case, one text after another; text i is
    ``raw[off[i]:off[i + 1]]``, word j ``raw[start[j]:end[j]]``, and the words of text i are those
    from ``first[i]`` up to ``first[i + 1]``.  A word ends at white space (with ``punctuation`` at any
    ASCII character that is no letter or digit too) or with its text.
    """

    def __init__(self, texts: pa.Array, punctuation: bool = False, fold: bool = False):
        if fold:  # all letters, not A-Z only
            texts = pc.utf8_lower(texts)
        texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = memoryview(texts.buffers()[2] or b"")[at[0] : at[-1]] if len(texts) else b""
        self.off = at - at[0]
        if texts.null_count:  # what stands under a null is not a text
            data, self.off = _without(data, self.off, np.asarray(texts.is_null()))
        self.raw = np.frombuffer(bytes(data).lower(), np.uint8)
        word = ~(_PUNCTUATION if punctuation else _SPACES)[self.raw]
        before = np.zeros(len(word) + 1, bool)
        before[1:] = word
        before[self.off] = False  # nothing stands before a text's first character, nor after its last
        self.start = np.flatnonzero(word & ~before[:-1])
        after = np.zeros(len(word) + 1, bool)
        after[:-1] = word
        after[self.off] = False
        self.end = np.flatnonzero(word & ~after[1:]) + 1
        self.first = np.searchsorted(self.start, self.off)
        self._hashes: dict[int, np.ndarray] = {}

    @property
    def lens(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def hashes(self) -> np.ndarray:
        """A polynomial of each word's bytes modulo 2**64, mixed; of equal words the same everywhere."""
        return self._hashed(0)

    @property
    def other_hashes(self) -> np.ndarray:
        """A second one, of another base and other values of bytes: with the first, 128 bits of each word."""
        return self._hashed(1)

    def _hashed(self, which: int) -> np.ndarray:
        if which not in self._hashes:
            up, values = _UPS[which], _BYTES[which]
            out, k, n = np.empty(len(self.start), _U), 0, len(self.start)
            while k < n:
                upto = max(int(np.searchsorted(self.end, self.start[k] + SEGMENT, "right")), k + 1)
                s, e = self.start[k:upto], self.end[k:upto]
                lo = int(s[0])
                if e[-1] - lo > SEGMENT:  # one very long word
                    out[k] = xxhash.xxh64_intdigest(self.raw[lo : e[0]].tobytes(), which)
                else:
                    part = self.raw[lo : e[-1]]
                    sums = np.zeros(len(part) + 1, _U)
                    np.cumsum(values[part] * up[: len(part)], out=sums[1:])
                    out[k:upto] = mix((sums[e - lo] - sums[s - lo]) * up[SEGMENT - (s - lo)])
                k = upto
            self._hashes[which] = out
        return self._hashes[which]

    def characters(self) -> np.ndarray:
        """Of each byte's place (and the end) the number of characters before it, over all texts."""
        out = np.zeros(len(self.raw) + 1, np.int64)
        np.cumsum((self.raw & 0xC0) != 0x80, out=out[1:])
        return out

    def places(self) -> np.ndarray:
        """Of each word its place in its text."""
        return np.arange(len(self.start)) - np.repeat(self.first[:-1], self.lens)


def _without(data, off: np.ndarray, null: np.ndarray) -> tuple[bytes, np.ndarray]:
    kept = [bytes(data[a:b]) for a, b, gone in zip(off, off[1:], null) if not gone]
    return b"".join(kept), np.concatenate([[0], np.cumsum(np.where(null, 0, np.diff(off)))])


def slices(batches: Iterable[pa.RecordBatch], text: int = 1) -> Iterator[pa.RecordBatch]:
    """Rows whose texts (in column ``text``) have SLICE bytes at most, or a single row."""
    for b in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(b.column(text)), 0)).astype(np.int64)
        total, at = np.cumsum(size), 0
        while at < b.num_rows:
            upto = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE, "right")), at + 1)
            yield b.slice(at, upto - at)
            at = upto


def spans(x: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The elements of all spans (start, length), one span after another."""
    n = np.asarray(n, np.int64)
    return x[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def run_hashes(h: np.ndarray, start: np.ndarray, n: np.ndarray, base: int = _BASE) -> np.ndarray:
    """A hash of the n words from each start: differences of running sums, brought to one power."""
    up, down = powers(base, len(h) + 1), powers(pow(base, -1, 1 << 64), len(h) + 1)
    sums = np.zeros(len(h) + 1, _U)
    np.cumsum(h * up[:-1], out=sums[1:])
    return (sums[start + n] - sums[start]) * down[start]
