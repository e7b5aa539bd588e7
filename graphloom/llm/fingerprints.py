"""Document fingerprints by MinHash: many universal hash permutations over shingles, vectorised over whole batches of text.

A fingerprint is the minimum of each of ``PERMUTATIONS`` multiply-add permutations of the 32-bit words over all of a text's
character shingles (16 bits of each minimum are kept, as hexadecimal text). The likeness of two fingerprints is the share of
equal minima, an unbiased estimate of the shingle sets' Jaccard similarity but for one part in 65,536. ``near_classes`` joins
signature bands over five-word shingles in Spark and verifies the Jaccard similarity of the candidates.

Null texts count as empty. An empty text has the fingerprint of no shingles, equal only to itself. A text shorter than a
shingle gives one shingle, its whole. Equal texts have equal fingerprints. Very long texts are hashed whole. Repeated rows
give repeated results; rows of one ``doc_id`` follow each other by text; null ids come first. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ngram_join
from ._spark import slim
from ._text import mix

PERMUTATIONS = 64
#: Characters of a fingerprint's shingle.
WIDTH = 8
#: Rows of one range of ids, about, and ranges at most; a range is streamed, so its length costs no memory.
RANGE_ROWS, RANGES = 4000, 20_000
BANDS, ROWS, MIN_JACCARD, WORDS = 20, 5, 0.8, 5
_BLOCK = 1024
_LEAST = -(2**63)


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (h[:n].astype(np.uint32) | np.uint32(1))[:, None], h[n:].astype(np.uint32)[:, None]


def minima(x: np.ndarray, n: int = PERMUTATIONS) -> np.ndarray:
    """Minimum of each permutation over 32-bit shingle hashes (all ones where there are none)."""
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    a, b = permutations(n)
    for at in range(0, len(x), _BLOCK):
        h = x[None, at : at + _BLOCK] * a
        h += b
        np.minimum(out, h.min(axis=1), out=out)
    return out


def char_shingles(text: str) -> np.ndarray:
    """32-bit hashes of the ``WIDTH``-character shingles; a shorter text is one shingle."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(c):
        return np.zeros(0, np.uint32)
    k = min(WIDTH, len(c))
    h = np.zeros(len(c) - k + 1, np.uint32)
    for j in range(k):  # a polynomial of the code points; what follows spreads it over all bits
        h *= np.uint32(0x01000193)
        h += c[j : len(c) - k + 1 + j] * np.uint32(0x9E3779B1)
    for shift, mult in ((15, 0x2C1B3C6D), (12, 0x297A2D39)):
        h ^= h >> np.uint32(shift)
        h *= np.uint32(mult)
    h ^= h >> np.uint32(15)
    return h


def fingerprint(text: str) -> np.ndarray:
    return minima(char_shingles(text))


def shown(m: np.ndarray) -> str:
    return (m & np.uint32(0xFFFF)).astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(((a ^ b) & np.uint32(0xFFFF) == 0).mean())


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the following text."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


class _Doc:
    """A text with the minima over the shingles that its edited text keeps, and over all."""

    def __init__(self, doc_id, text: str):
        self.id, self.text = doc_id, text
        n = len(text)
        self.kept = n - n // 4 - WIDTH + 1
        x = char_shingles(text)
        if self.kept > 0:
            self.shared = minima(x[: self.kept])
            self.own = np.minimum(self.shared, minima(x[self.kept :]))
        else:
            self.own = minima(x)

    def row(self, following: "_Doc") -> tuple:
        e = edited(self.text, following.text)
        if self.kept > 0:
            m = np.minimum(self.shared, minima(char_shingles(e[self.kept :]))) if len(e) - self.kept >= WIDTH else self.shared
        else:
            m = fingerprint(e)
        return self.id, len(self.text), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), shown(self.own), shown(m), likeness(self.own, m), likeness(self.own, following.own)


_OUT = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _run(batches):
    """Rows arrive by range, in order, and then the head of the following range."""
    part, waiting, closed = None, None, False
    for batch in batches:
        rows = []
        for p, head, i, t in zip(*(batch.column(c).to_pylist() for c in ("_part", "_head", "doc_id", "text"))):
            if p != part:
                part, waiting, closed = p, None, False
            if closed:
                continue
            doc = _Doc(i, t)
            if waiting is not None:
                rows.append(waiting.row(doc))
            waiting, closed = doc, head
        if rows:
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], names=list(_OUT))


def with_next(docs: DataFrame) -> DataFrame:
    """Fingerprint of each text and of its edited text, into which the next document by ascending id (after the last, the first) is mixed.

    Approximate quantiles cut the ids into ranges of bounded size; each range is worked off in order, and the first row of a
    range also goes to the range before it. Only the bounds and first ids of the ranges come to the driver.
    """
    d = slim(docs).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("_key", F.coalesce("doc_id", F.lit(_LEAST)))
    parts = max(1, min(RANGES, d.count() // RANGE_ROWS))
    bounds = np.unique(np.array(d.approxQuantile("_key", [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 else [], float))
    held = d.sparkSession.sparkContext.broadcast(bounds)

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(held.value, ids.to_numpy().astype(float), "right").astype(np.int32))

    ranged = d.select("_key", place("_key").alias("_part"))
    first = sorted((r["_part"], r["i"]) for r in ranged.groupBy("_part").agg(F.min("_key").alias("i")).collect())
    heads = d.sparkSession.createDataFrame([(i, first[k - 1][0]) for k, (_, i) in enumerate(first)], "_key long, _before int")
    spread = d.withColumn("_part", place("_key")).join(F.broadcast(heads), "_key", "left")
    spread = spread.select("doc_id", "text", "_key", F.explode(F.when(F.col("_before").isNull(), F.array(F.struct(F.col("_part"), F.lit(False).alias("_head")))).otherwise(F.array(F.struct(F.col("_part"), F.lit(False).alias("_head")), F.struct(F.col("_before").alias("_part"), F.lit(True).alias("_head"))))).alias("_to"))
    spread = spread.select("doc_id", "text", "_key", "_to._part", "_to._head")
    tasks = max(1, min(len(first), 2 * int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = spread.repartition(tasks, "_part").sortWithinPartitions("_part", "_head", "_key", "text").select("_part", "_head", "doc_id", "text")
    return dealt.mapInArrow(_run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def band_hashes(x: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signature bands of the sets that follow each other in x, and their owners."""
    ends = np.cumsum(size)
    m = np.array([minima((x[a:b] >> np.uint64(32)).astype(np.uint32), BANDS * ROWS) for a, b in zip(ends - size, ends)], np.uint64).reshape(-1, BANDS, ROWS)
    weights = mix(np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    bands = mix((m * weights).sum(axis=2, dtype=np.uint64) + mix(np.arange(1, BANDS + 1, dtype=np.uint64)))
    return bands.reshape(-1).astype(np.int64), np.repeat(np.arange(len(size)), BANDS)


def near_classes(docs: DataFrame, threshold: float = MIN_JACCARD) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: documents that share a signature band meet, and are linked where the Jaccard
    similarity of their five-word shingles is verified to be ``threshold`` or more; component_id is the smallest id reachable by links.

    Every pair that shares a band, directly or through others, is verified or known to be connected: no head of a band stands for
    its members. Only the bands can miss a link (of 0.8, one in 1,600; of 0.85 and more, less than one in 20,000).
    """
    return ngram_join.classes(docs, WORDS, round(100 * threshold), band_hashes)
