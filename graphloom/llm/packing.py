"""Best-fit packing of documents into fixed-length sequences, by patterns fitted with non-negative least squares.

Documents are encoded and, only where longer than a sequence, cut into pieces. The histogram of piece lengths (2048 numbers,
whatever the number of documents) is all that the plan needs: patterns of a few lengths that fill a sequence are enumerated,
their repeat counts are fitted to the histogram by non-negative least squares and rounded, and the rest is packed best-fit
by decreasing length. The plan is a bounded table of runs: pieces of a length with ranks from ``lo`` on go to the sequences
from ``base`` on at one offset. Each piece then finds its place by its length and its rank among pieces of that length.

Null and empty texts are documents of one token, the end. Repeated rows are packed as often as they come. Ties in length are
ordered by document, piece and content. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import array
import json
import re
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import by_slice, cut, slim
from ._text import worker_cache
from .bpe import SPACE, byte_symbols

LENGTH = 2048
END = 0
#: Chunks that a worker remembers; workers outlive the stage, so what they hold is held beside the next ones'.
CACHE_CHUNKS = 100_000
#: Pieces of one length that one task ranks, about.
RANKED = 20_000
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
# The byte vocabulary's pieces of text, and its special token.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = {"<|endoftext|>": 50256}
_BLANK = re.compile(f"[{SPACE}]{{1000,}}")


class _Chunks(dict):
    """Ids, as little-endian 32-bit words, of what stands between two spaces, with the space before it."""

    def __init__(self, whole, single):
        super().__init__()
        self.whole, self.single = whole, single

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHE_CHUNKS:
            self.clear()
        if chunk.isalpha():  # letters only: one piece
            ids = self.single((" " + chunk).encode())
        elif chunk[:-1].isalpha() and chunk[-1] in ".,":
            ids = [*self.single((" " + chunk[:-1]).encode()), *self.single(chunk[-1].encode())]
        else:
            ids = self.whole(" " + chunk)
        out = array.array("I", ids).tobytes()
        if len(chunk) <= 256:
            self[chunk] = out
        return out


class ByteEncoder:
    """Ids of whole texts under the byte vocabulary, as 32-bit words. A space after something else always starts a piece."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        back = {c: b for b, c in enumerate(byte_symbols())}
        # merges are listed in the order of the ids of what they make
        ranks = {bytes(back[c] for c in token): i for token, i in vocabulary.items() if token not in SPECIAL}
        core = tiktoken.Encoding("byte_bpe", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.whole, self.single = core.encode_ordinary, core.encode_single_piece
        self.chunks = _Chunks(core.encode_ordinary, core.encode_single_piece)

    def _plain(self, text: str) -> bytes:
        """White space of a thousand and more characters is cut out: the pattern engine would run out of its stack there.

        By the pattern such a run is one piece, but for its last character where something follows, which goes with that.
        """
        if not _BLANK.search(text):
            return self._words(text) if text else b""
        out, at = [], 0
        for m in _BLANK.finditer(text):
            end = m.end() - (m.end() < len(text))
            out += [self._words(text[at : m.start()]) if m.start() > at else b"", array.array("I", self.single(text[m.start() : end].encode())).tobytes()]
            at = end
        return b"".join([*out, self._words(text[at:]) if at < len(text) else b""])

    def _words(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if "" in rest or not first:
            return array.array("I", self.whole(text)).tobytes()
        return array.array("I", self.whole(first)).tobytes() + b"".join(map(self.chunks.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        out, at = [], 0
        for name, i in SPECIAL.items():
            while (to := text.find(name, at)) >= 0:
                out += [self._plain(text[at:to]) if to > at else b"", array.array("I", [i]).tobytes()]
                at = to + len(name)
        rest = text[at:]
        return b"".join([*out, self._plain(rest) if rest else b""])


def pieces(docs: DataFrame, path: str) -> DataFrame:
    """Each document's pieces; the first of a long document takes what is left over from whole sequences."""

    def kernel(part):
        enc = worker_cache(("byte_bpe", path), lambda: ByteEncoder(path))
        rows = []
        for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
            ids = enc.encode(text) + END.to_bytes(4, "little")
            n, at, k = len(ids) // 4, 0, 0
            while at < n:
                to = at + ((n - at) % LENGTH or LENGTH) if k == 0 and n > LENGTH else min(n, at + LENGTH)
                rows.append((doc, k, at, to - at, zlib.crc32(ids[4 * at : 4 * to])))
                at, k = to, k + 1
        cols = list(zip(*rows))
        return {c: pa.array(v, t) for (c, t), v in zip((("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())), cols)}

    return by_slice(slim(docs), kernel, SCHEMA)


def patterns(lengths: np.ndarray, size: int = LENGTH) -> np.ndarray:
    """Patterns of one to four of the given lengths that fill a sequence well, as rows of lengths padded with 0."""
    have = np.sort(lengths)
    best = lambda room: np.where(room >= have[0], have[np.clip(np.searchsorted(have, room, "right") - 1, 0, None)], 0)  # noqa: E731  the largest that fits
    grid = np.unique(have[np.linspace(0, len(have) - 1, min(len(have), 24)).astype(int)])
    coarse = grid[:: max(1, len(grid) // 6)]
    out = []
    b = best(size - have)
    out.append(np.stack([have, b, best(size - have - b), np.zeros_like(have)], axis=1))
    for step in (1, 2):  # the next smaller ones
        lower = have[np.clip(np.searchsorted(have, b, "left") - step, 0, None)]
        lower = np.where((b > 0) & (lower + have <= size), lower, 0)
        out.append(np.stack([have, lower, best(size - have - lower), np.zeros_like(have)], axis=1))
    a3, b3 = (x.ravel() for x in np.meshgrid(have, grid))
    ok = a3 + b3 <= size
    a3, b3 = a3[ok], b3[ok]
    c3 = best(size - a3 - b3)
    out.append(np.stack([a3, b3, c3, best(size - a3 - b3 - c3)], axis=1))
    a4, b4, c4 = (x.ravel() for x in np.meshgrid(have, coarse, coarse))
    ok = (a4 + b4 + c4 <= size) & (b4 <= c4)
    a4, b4, c4 = a4[ok], b4[ok], c4[ok]
    out.append(np.stack([a4, b4, c4, best(size - a4 - b4 - c4)], axis=1))
    return np.unique(-np.sort(-np.concatenate(out), axis=1), axis=0)


def fit(counts: np.ndarray, pats: np.ndarray, rounds: int = 2000, tol: float = 1e-4) -> np.ndarray:
    """Non-negative repeat counts x of the patterns that minimise ||A x - counts||^2, by accelerated projected gradient until a round moves x by less than ``tol`` of it."""
    size = len(counts)
    scale = 1 / np.sqrt(np.maximum(counts, 1.0))  # a relative fit: rare lengths count as well
    used = (pats > 0).astype(float)
    weigh = lambda x: np.bincount(pats.ravel(), (used * x[:, None]).ravel(), minlength=size)  # noqa: E731  A x
    back = lambda r: (r[pats] * used).sum(axis=1)  # noqa: E731  A' r
    x = np.zeros(len(pats))
    v = np.ones(len(pats))
    for _ in range(20):  # the largest eigenvalue, for the step
        v = back(scale**2 * weigh(v))
        top = np.linalg.norm(v)
        v /= top
    y, t = x.copy(), 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(scale**2 * (weigh(y) - counts)) / (1.02 * top))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        moved, x, t = np.linalg.norm(new - x), new, t2
        if moved <= tol * np.linalg.norm(x):
            break
    return x


def plan(counts: np.ndarray, size: int = LENGTH) -> tuple[np.ndarray, int]:
    """Rows (length, lo, count, base, offset) that place all pieces, and the number of sequences. counts: by length, from 0 to size."""
    left = counts.astype(np.int64).copy()
    runs: list[tuple[tuple[int, ...], int]] = [((size,), int(left[size]))] if left[size] else []
    left[size] = 0
    have = np.flatnonzero(left)
    if len(have):
        pats = patterns(have, size)
        x = fit(left.astype(float), pats)
        for i in np.lexsort((-x, -pats.sum(axis=1))):  # the fullest first
            if x[i] < 0.5:
                continue
            own, n = np.unique(pats[i][pats[i] > 0], return_counts=True)
            times = int(min(round(x[i]), (left[own] // n).min()))
            if times > 0 and own.dot(n) >= 0.97 * size:
                left[own] -= times * n
                runs.append((tuple(int(v) for v in pats[i] if v), times))
    runs += _best_fit(left, size)
    rows, used, base = [], np.zeros(size + 1, np.int64), 0
    for pat, times in runs:
        at = 0
        for v in pat:
            rows.append((v, used[v], times, base, at))
            used[v] += times
            at += v
        base += times
    assert (used == counts).all()
    return np.array(sorted(rows), np.int64).reshape(-1, 5), base


def _best_fit(left: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit by decreasing length, over counts: equal bins are handled as one group."""
    groups: dict[int, list[list]] = {}  # by room left: [pattern, count]
    rooms = np.zeros(size + 1, bool)
    done = []

    def put(room: int, pat: tuple, n: int) -> None:
        if room == 0:
            done.append((pat, n))
        else:
            groups.setdefault(room, []).append([pat, n])
            rooms[room] = True

    for v in range(size, 0, -1):
        n = int(left[v])
        while n:
            fits = np.flatnonzero(rooms[v:])
            if len(fits):
                room = v + int(fits[0])
                pat, m = groups[room].pop()
                if not groups[room]:
                    rooms[room] = False
                k = min(room // v, n)
                times = min(m, n // k)
                if m > times:
                    put(room, pat, m - times)
                put(room - k * v, pat + (v,) * k, times)
                n -= k * times
            else:
                k = min(size // v, n)
                put(size - k * v, (v,) * k, n // k)
                n -= n // k * k
    return done + [(p, n) for g in groups.values() for p, n in g]


def pack(docs: DataFrame, path: str) -> DataFrame:
    """Every piece with its sequence and its place there."""
    cutted = cut(pieces(docs, path))
    hist = {r["length"]: r["count"] for r in cutted.groupBy("length").count().collect()}  # LENGTH rows at most
    counts = np.zeros(LENGTH + 1, np.int64)
    for k, v in hist.items():
        counts[k] = v
    rows, _ = plan(counts)
    held = docs.sparkSession.sparkContext.broadcast(rows)
    buckets = max(8, int(counts.max()) // RANKED + 1)
    keyed = cutted.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = keyed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))).select("length", "_bucket", F.coalesce("_before", F.lit(0)).alias("_before"))
    ranked = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")))
    ranked = ranked.join(before, ["length", "_bucket"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_rank") - 1).alias("_rank"))

    def place(batches):
        table = held.value
        keys = table[:, 0] << np.int64(45) | table[:, 1]
        for b in batches:
            if not len(b):
                continue
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            at = np.searchsorted(keys, length << np.int64(45) | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(table[at, 3] + rank - table[at, 1]), pa.array(table[at, 4])], names=[*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{SCHEMA}, sequence_id long, offset long")
