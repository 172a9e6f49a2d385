"""Monotone sequences in Elias-Fano form, read in whole arrays of queries from memory-mapped files."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import uuid

import numpy as np
from pyarrow import fs

_U = np.uint64
_ONE = _U(1)
HINT = 64


def save(folder: str, name: str, array: np.ndarray) -> None:
    """Writes an array so that a task that is run again or twice leaves the same whole file.

    ``folder`` is a path of a file system that all machines mount, or the URI of a store that Arrow reaches.
    """
    if "://" in folder:
        store, path = fs.FileSystem.from_uri(folder)
        held = io.BytesIO()
        np.save(held, array)
        with store.open_output_stream(f"{path}/{name}.npy") as f:  # a store shows a file once it is whole
            f.write(held.getbuffer())
        return
    part = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        np.save(f, array)
    os.replace(part, f"{folder}/{name}.npy")


def load(folder: str, name: str) -> np.ndarray:
    """The array, memory-mapped; from a store by way of a copy of this machine's own, which any task may make anew."""
    path = f"{folder}/{name}.npy" if "://" not in folder else _copied(folder, name)
    return np.asarray(np.load(path, mmap_mode="r"))  # still mapped, as a plain array


def exists(folder: str, name: str) -> bool:
    if "://" not in folder:
        return os.path.exists(f"{folder}/{name}.npy")
    store, path = fs.FileSystem.from_uri(folder)
    return store.get_file_info(f"{path}/{name}.npy").type == fs.FileType.File


def _copied(folder: str, name: str) -> str:
    own = f"{tempfile.gettempdir()}/tessella-{hashlib.sha256(folder.encode()).hexdigest()[:16]}"
    if not os.path.exists(f"{own}/{name}.npy"):
        os.makedirs(own, exist_ok=True)
        store, path = fs.FileSystem.from_uri(folder)
        part = f"{own}/.{name}-{uuid.uuid4().hex}"
        with store.open_input_stream(f"{path}/{name}.npy") as f, open(part, "wb") as out:
            while piece := f.read(8 << 20):
                out.write(piece)
        os.replace(part, f"{own}/{name}.npy")
    return f"{own}/{name}.npy"


def _select(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the rank-th set bit in each word."""
    w, r, at = words.copy(), rank.astype(np.int64), np.zeros(len(words), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        n = np.bitwise_count(w & _U((1 << width) - 1)).astype(np.int64)
        go = r >= n
        r -= n * go
        at += width * go
        w = np.where(go, w >> _U(width), w)
    return at


class EliasFano:
    """n sorted values below ``universe``: low bits packed, high bits in unary."""

    #: ``hint``: the word of each HINT-th zero of the high bits, from which the words of others are not far.
    NAMES = ("head", "low", "high", "ones", "zeros", "hint")

    def __init__(self, head, low, high, ones, zeros, hint):
        self.n, self.universe, self.width = (int(x) for x in head)
        self.low, self.high, self.ones, self.zeros, self.hint = low, high, ones, zeros, hint

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        v, n = values.astype(_U), len(values)
        width = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
        high = (v >> _U(width)).astype(np.int64)
        bits = np.zeros((n + (universe >> width) + 2 + 63) // 64 * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        words = np.packbits(bits, bitorder="little").view(_U)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        zeros = 64 * np.arange(len(words) + 1, dtype=np.int64) - ones
        packed = np.zeros(n * width // 64 + 2, _U)
        if width and n:
            low, at = v & _U((1 << width) - 1), np.arange(n, dtype=np.int64) * width
            word, shift = at >> 6, (at & 63).astype(_U)
            np.bitwise_or.at(packed, word, low << shift)
            over = (at & 63) + width > 64
            np.bitwise_or.at(packed, word[over] + 1, low[over] >> (_U(64) - shift[over]))
        hint = np.searchsorted(zeros, np.arange(0, zeros[-1] + 1, HINT), side="right") - 1
        return cls((n, universe, width), packed, words, ones, zeros, hint)

    def store(self, folder: str, name: str) -> None:
        head = np.array([self.n, self.universe, self.width], _U)
        for part, array in zip(self.NAMES, (head, self.low, self.high, self.ones, self.zeros, self.hint)):
            save(folder, f"{name}.{part}", array)

    @classmethod
    def open(cls, folder: str, name: str) -> EliasFano:
        return cls(*(load(folder, f"{name}.{part}") for part in cls.NAMES))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), _U)
        at = i * self.width
        word, shift = at >> 6, (at & 63).astype(_U)
        up = (_U(64) - shift) & _U(63)
        more = np.where(shift > 0, self.low[word + 1] << up, _U(0))
        return ((self.low[word] >> shift) | more) & _U((1 << self.width) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at places i."""
        j = np.searchsorted(self.ones, i, side="right") - 1
        high = j * 64 + _select(self.high[j], i - self.ones[j]) - i
        return (high.astype(_U) << _U(self.width)) | self._low(i)

    def _zero(self, h: np.ndarray) -> np.ndarray:
        """Place in the high bits of the zero before those values whose high bits are h (-1 for h = 0)."""
        out, k = np.full(len(h), -1, np.int64), np.flatnonzero(h > 0)
        z = h[k] - 1
        j = self._word_of_zero(z)
        out[k] = j * 64 + _select(~self.high[j], z - self.zeros[j])
        return out

    def _word_of_zero(self, z: np.ndarray) -> np.ndarray:
        """The word of each zero: a few steps from its hint, or a search where ones stand thick."""
        j = self.hint[z // HINT]
        for _ in range(6):
            on = self.zeros[j + 1] <= z
            if not on.any():
                return j
            j = j + on
        far = np.flatnonzero(self.zeros[j + 1] <= z)
        j[far] = np.searchsorted(self.zeros, z[far], side="right") - 1
        return j

    def _ones_from(self, at: np.ndarray, h: np.ndarray) -> np.ndarray:
        """How many ones stand from places ``at`` to the next zero, the one after high bits h."""
        left = 64 - (at & 63)
        rest = ~(self.high[at >> 6] >> (at & 63).astype(_U))
        run = np.bitwise_count((rest & (~rest + _ONE)) - _ONE).astype(np.int64)
        more = np.flatnonzero(run >= left)  # up to the word's end
        if len(more):
            run[more] = self._zero(h[more] + 1) - at[more]
        return run

    def _search(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the first value not below v, the end of the values that share v's high bits, v's low bits."""
        v = v.astype(_U)
        high = (v >> _U(self.width)).astype(np.int64)
        at = self._zero(high) + 1
        lo, low = at - high, v & _U((1 << self.width) - 1)
        end = lo + self._ones_from(at, high)
        hi = end.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < low[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        return lo, end, low

    def successor(self, v: np.ndarray) -> np.ndarray:
        return self._search(v)[0]

    def find(self, v: np.ndarray) -> np.ndarray:
        """Place of each value, -1 where there is none: a successor with the same high and low bits."""
        at, end, low = self._search(v)
        out, inside = np.full(len(at), -1, np.int64), np.flatnonzero(at < end)
        hit = inside[self._low(at[inside]) == low[inside]]
        out[hit] = at[hit]
        return out
