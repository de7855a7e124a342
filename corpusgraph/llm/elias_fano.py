"""Elias-Fano sequences over arrays that can be memory-mapped, with vectorised access and search."""

from __future__ import annotations

import json
import uuid

import numpy as np


def _select_in_word(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th (from 0) set bit of each word."""
    at = np.zeros(len(words), np.int64)
    k = k.copy()
    for width in (32, 16, 8, 4, 2, 1):
        n = np.bitwise_count(words & np.uint64((1 << width) - 1)).astype(np.int64)
        up = k >= n
        k -= np.where(up, n, 0)
        words = np.where(up, words >> np.uint64(width), words)
        at += np.where(up, width, 0)
    return at


class EliasFano:
    """A non-decreasing sequence of unsigned 64-bit values."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high).astype(np.int64))])
        self.ones, self.zeros = ones, np.arange(len(ones)) * 64 - ones

    @staticmethod
    def build(values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        l = max(0, (top // max(n, 1)).bit_length() - 1)
        high_at = (values >> np.uint64(l)).astype(np.int64) + np.arange(n)
        size = (int(high_at[-1]) if n else 0) + 2
        bits = np.zeros((size + 63) // 64 * 64, np.uint8)
        bits[high_at] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        low = np.zeros((n * l + 63) // 64 + 1, np.uint64)
        if l:
            part = values & np.uint64((1 << l) - 1)
            at = np.arange(n, dtype=np.int64) * l
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, word, part << shift)
            over = (at & 63) + l > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        return EliasFano(n, l, low, high)

    def _low(self, k: np.ndarray) -> np.ndarray:
        l = self.low_bits
        if not l:
            return np.zeros(len(k), np.uint64)
        at = k * l
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        out = self.low[word] >> shift
        over = (at & 63) + l > 64
        out[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return out & np.uint64((1 << l) - 1)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th zero of the high bits, past the end if there is none."""
        word = np.minimum(np.searchsorted(self.zeros, k, "right") - 1, len(self.high) - 1)
        return np.where(k < self.zeros[-1], word * 64 + _select_in_word(~self.high[word], k - self.zeros[word]), len(self.high) * 64)

    def access(self, k: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, k, "right") - 1
        at = word * 64 + _select_in_word(self.high[word], k - self.ones[word])
        return ((at - k).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(k)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each value, -1 where it does not occur."""
        if not self.n or not len(values):
            return np.full(len(values), -1, np.int64)
        bucket = np.minimum(values >> np.uint64(self.low_bits), np.uint64(1 << 62)).astype(np.int64)
        inside = bucket < self.zeros[-1]
        b = np.where(inside, bucket, 0)
        lo = np.where(b > 0, self._zero(np.maximum(b - 1, 0)) - np.maximum(b - 1, 0), 0)
        hi = np.minimum(self._zero(b) - b, self.n)
        end, wanted = hi, values & np.uint64((1 << self.low_bits) - 1)
        lo = np.minimum(lo, self.n)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < wanted[open_]
            lo[open_[less]] = mid[less] + 1
            hi = hi.copy()
            hi[open_[~less]] = mid[~less]
        ok = inside & (lo < end)
        out = np.full(len(values), -1, np.int64)
        at = np.flatnonzero(ok)
        out[at] = np.where(self._low(lo[at]) == wanted[at], lo[at], -1)
        return out

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.meta": np.array([self.n, self.low_bits], np.int64), f"{name}.low": self.low, f"{name}.high": self.high}

    @staticmethod
    def of(arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, l = arrays[f"{name}.meta"]
        return EliasFano(int(n), int(l), arrays[f"{name}.low"], arrays[f"{name}.high"])


# --- level files in the shared folder ---------------------------------------------------------------


def save(folder: str, arrays: dict[str, np.ndarray]) -> str:
    """Writes arrays as one file of a new name and gives its path."""
    where, base = _located(folder)
    name = f"{uuid.uuid4().hex}.level"
    head, at, parts = {}, 0, []
    for k, v in arrays.items():
        v = np.ascontiguousarray(v)
        head[k] = (at, v.dtype.str, len(v))
        pad = -v.nbytes % 64
        parts += [v.tobytes(), b"\0" * pad]
        at += v.nbytes + pad
    text = json.dumps(head).encode()
    where.create_dir(base, recursive=True)
    with where.open_output_stream(f"{base}/{name}") as f:
        f.write(len(text).to_bytes(8, "little") + text)
        f.write(b"\0" * (-(8 + len(text)) % 64))
        for p in parts:
            f.write(p)
    return f"{folder}/{name}"


def _located(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def mounted(path: str) -> bool:
    """Whether the path can be memory-mapped."""
    from pyarrow import fs

    return isinstance(_located(path)[0], fs.LocalFileSystem)


def load(path: str) -> dict[str, np.ndarray]:
    """Maps the arrays of a file; one that is not on a mounted path is read into memory."""
    where, base = _located(path)
    if mounted(path):
        whole = np.memmap(base, np.uint8, "r")
    else:
        with where.open_input_stream(base) as f:
            whole = np.frombuffer(f.read(), np.uint8)
    size = int.from_bytes(whole[:8].tobytes(), "little")
    head = json.loads(whole[8 : 8 + size].tobytes())
    start = (8 + size + 63) // 64 * 64
    return {k: whole[start + at : start + at + n * np.dtype(kind).itemsize].view(kind) for k, (at, kind, n) in head.items()}
