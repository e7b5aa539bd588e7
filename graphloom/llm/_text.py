"""Whole-batch text kernels: Arrow string columns are tokenised and hashed as byte arrays, without a Python loop over words."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that a kernel handles at a time (a longer single document is handled alone).
CHUNK_BYTES = 1 << 20
_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MULT = np.uint64(0x9E3779B97F4A7C15)
_STEP = 6364136223846793005
_STEP_INV = pow(_STEP, -1, 1 << 64)


def worker_cache(key, make: Callable):
    """One object per Python worker process and key, made on first use; it outlives tasks when workers are reused."""
    held = sys.modules.setdefault("_graphloom_worker_cache", types.ModuleType("_graphloom_worker_cache")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def _salt(j: int) -> np.uint64:
    return np.uint64(j * int(_MULT) & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _MULT)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    held = worker_cache("powers", lambda: [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    if len(held[0]) < n:
        size = n + n // 4
        for i, step in enumerate((_STEP, _STEP_INV)):
            a = np.full(size, step, np.uint64)
            a[0] = 1
            held[i] = np.multiply.accumulate(a)
    return held[0], held[1]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in runs of at most ``limit`` bytes of text, one row at least; null texts become empty."""
    for batch in batches:
        i = batch.schema.get_field_index(column)
        col = batch.column(i)
        col = (col if pa.types.is_large_string(col.type) else col.cast(pa.large_string())).fill_null("")
        batch = batch.set_column(i, column, col)
        if not len(batch):
            continue
        ends = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        at = 0
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def mapped(raw: np.ndarray, table: np.ndarray) -> np.ndarray:
    """``table[raw]`` of bytes by a table of 256 one-byte values; read only."""
    return np.frombuffer(raw.tobytes().translate(table.tobytes()), table.dtype)


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a slice of texts, as spans of bytes."""

    def __init__(self, column: pa.Array, lower: bool):
        n = len(column)
        off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
        raw = np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]] if column.buffers()[2] is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        self.n, self.off = n, off - off[0]
        self.raw = raw
        self.data = mapped(raw, _LOWER) if lower else raw
        ws = mapped(raw, _WS)
        self.ws = ws
        edge = np.ones(len(raw) + 1, bool)  # positions where a word may start: after white space or at a text's start
        edge[1:] = np.append(ws[1:] != ws[:-1], True) if len(raw) else edge[1:]
        edge[self.off] = True
        cut = np.flatnonzero(edge)
        keep = ~ws[cut[:-1]] if len(cut) > 1 else np.zeros(0, bool)
        self.start, self.end = cut[:-1][keep], cut[1:][keep]
        self.first = np.searchsorted(self.start, self.off)  # word index at which each text starts
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(n), self.count)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes."""
        p, inv = _powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        terms = np.take(_BYTE, self.data)
        terms *= p[: len(self.data)]
        np.cumsum(terms, out=total[1:])
        h = (total[self.end] - total[self.start]) * inv[self.start]
        return mix(h + (self.end - self.start).astype(np.uint64) * _MULT)

    def per_doc(self, mask: np.ndarray) -> np.ndarray:
        """Sums over each text's bytes."""
        s = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=s[1:])
        return s[self.off[1:]] - s[self.off[:-1]]

    def chars(self) -> np.ndarray:
        """Code points of each text."""
        return self.per_doc((self.raw & 0xC0) != 0x80)


def shingles(words: Words, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of each k-word shingle in reading order; a text of 1 to k-1 words gives its whole sequence as one."""
    m = len(hashes)
    out, docs = [], []
    if m >= k:
        h = np.zeros(m - k + 1, np.uint64)
        for j in range(k):
            h += mix(hashes[j : m - k + 1 + j] + _salt(j + 1))
        ok = words.doc[: m - k + 1] == words.doc[k - 1 :]
        out.append(mix(h[ok]))
        docs.append(words.doc[: m - k + 1][ok])
    for n in range(1, k):
        short = np.flatnonzero(words.count == n)
        if len(short):
            h = np.full(len(short), _salt(n), np.uint64)
            for j in range(n):
                h += mix(hashes[words.first[short] + j] + _salt(j + 1))
            out.append(mix(h ^ np.uint64(n)))
            docs.append(short)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, d = np.concatenate(out), np.concatenate(docs)
    if len(out) > 1:
        o = np.argsort(d, kind="stable")
        h, d = h[o], d[o]
    return h, d
