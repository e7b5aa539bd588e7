"""Substring dedup by content-defined chunking: a gear rolling hash cuts texts into variable chunks, chunks are compared by
64-bit digest, and matching chunks are anchors: once their texts agree, a passage is followed from them to its exact ends.

A cut stands where the hash of the last 16 bytes is the least within ``REACH`` bytes on both sides, so it depends on what is
near and on no earlier cut: a passage is cut alike in all texts but for its edges. The first document (by id) that has a chunk
keeps it; in a later document, neighbouring chunks of the same place are widened, character by character, as far as both texts
agree, and what overlaps or touches is one passage. One of ``MIN_CHARS`` or more characters is a repeat. What a document
repeats of itself is left alone, and so are short common lines.

Null texts and null ids have no repeats and stay as they are; empty texts have no chunks. Texts are cut whole, however long.
Rows that repeat a ``doc_id`` count as the same document. Empty tables give empty results. Other columns are kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import by_slice, cut, slim
from ._text import mix

#: Bytes of a chunk, at least and at most (but for a text's last one); bytes on either side among which a cut has the least hash.
LEAST, MOST, REACH = 16, 80, 16
#: Code points of a repeat, at least. Passages are measured by their exact ends.
MIN_CHARS = 140
#: Code points that an anchor is widened by, at most. Within a passage the first cut comes ``WINDOW + REACH`` bytes and one chunk
#: after its start at the latest, the last one ``REACH`` bytes and one chunk before its end, so this is beyond any edge.
EDGE = 128
WINDOW = 16
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(32)).astype(np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """Gear hash of the ``WINDOW`` bytes that end at each place: sum of the bytes' gears, each shifted by its age."""
    h = _GEAR[data]
    w = 1
    while w < WINDOW:
        h[w:] += h[:-w] << np.uint32(w)
        w *= 2
    return h


def cuts(data: np.ndarray) -> list[int]:
    """Ends of the chunks of one text's bytes; none lies inside a character."""
    n = len(data)
    if not n:
        return []
    opens = np.append((data[1:] & 0xC0) != 0x80, True)  # the next byte starts a character
    none = np.uint32(0xFFFFFFFF)
    h = np.where(opens, rolling(data.copy()), none)
    low = np.full(n + 2 * REACH, none)
    low[REACH : REACH + n] = h
    w = 1
    while w < REACH:
        low = np.minimum(low[:-w], low[w:])
        w *= 2
    places = np.flatnonzero((h < low[:n]) & (h <= low[REACH + 1 : REACH + 1 + n])) + 1
    places = places[(places >= LEAST) & (places <= n - LEAST)].tolist()
    out, last = [], 0
    for place in [*places, n]:
        while place - last > MOST:  # a stretch without a cut of its own
            to = last + MOST
            while to < place and not opens[to - 1]:
                to += 1
            if to >= place:
                break
            out.append(to)
            last = to
        out.append(place)
        last = place
    return out


def chunks(docs: DataFrame) -> DataFrame:
    """(digest, doc_id, start, length, fresh) of each chunk: its 64-bit digest, its place in code points, and whether its text had none like it before."""

    def kernel(part):
        d, ids, starts, lengths, fresh = [], [], [], [], []
        for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
            raw = t.encode("utf-8", "surrogatepass")
            data = np.frombuffer(raw, np.uint8)
            ends = cuts(data)
            if not ends:
                continue
            plain = len(t) == len(raw)
            at = [0, *ends]
            chars = at if plain else np.append(0, np.cumsum((data & 0xC0) != 0x80))[at].tolist()
            own = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(at, ends)]
            seen: set[int] = set()
            fresh += [not (x in seen or seen.add(x)) for x in own]
            d += own
            ids += [i] * len(ends)
            starts += chars[:-1]
            lengths += [b - a for a, b in zip(chars, chars[1:])]
        if not d:
            return None
        return {"digest": np.array(d, np.uint64).view(np.int64), "doc_id": pa.array(ids, pa.int64()), "start": pa.array(starts, pa.int32()), "length": pa.array(lengths, pa.int32()), "fresh": pa.array(fresh, pa.bool_())}

    return by_slice(slim(docs).filter("doc_id is not null and text <> ''"), kernel, "digest long, doc_id long, start int, length int, fresh boolean")


def anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, start, stop, first, place) of neighbouring chunks that an earlier document has in the same order, from ``place`` on.

    Digests are summed up before they are shuffled, so a chunk that a third of all documents have costs a row a task; the join
    back splits where one digest has many places.
    """
    found = chunks(docs)
    held = found.filter("fresh").groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min_by("start", "doc_id").alias("place")).filter("first < last").select("digest", "first", "place")
    again = found.drop("fresh").join(held, "digest").filter("first < doc_id").select("doc_id", "start", "length", "first", (F.col("start") - F.col("place")).alias("shift")).dropDuplicates(["doc_id", "start"])
    order = Window.partitionBy("doc_id").orderBy("start")
    same = (F.col("start") == F.lag(F.col("start") + F.col("length")).over(order)) & (F.col("first") == F.lag("first").over(order)) & (F.col("shift") == F.lag("shift").over(order))
    runs = again.withColumn("_gap", F.when(same, 0).otherwise(1)).withColumn("_run", F.sum("_gap").over(order))
    return runs.groupBy("doc_id", "_run").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("stop"), F.min("first").alias("first"), F.min(F.col("start") - F.col("shift")).alias("place")).drop("_run")


def edges(docs: DataFrame, places: DataFrame) -> DataFrame:
    """The given rows (doc_id, start, stop, first, place), each with what stands ``before`` and ``after`` it in its text, and a 128-bit digest of its ``own`` text."""

    def kernel(part):
        out = [(i, p["start"], p["stop"], p["first"], p["place"], t[max(0, p["start"] - EDGE) : p["start"]], t[p["stop"] : p["stop"] + EDGE], xxhash.xxh3_128_digest(t[p["start"] : p["stop"]].encode("utf-8", "surrogatepass"))) for i, t, own in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("places").to_pylist()) for p in own]
        kinds = {"doc_id": pa.int64(), "start": pa.int32(), "stop": pa.int32(), "first": pa.int64(), "place": pa.int32(), "before": pa.string(), "after": pa.string(), "own": pa.binary()}
        return {c: pa.array([row[k] for row in out], kind) for k, (c, kind) in enumerate(kinds.items())}

    own = places.groupBy("doc_id").agg(F.collect_set(F.struct("start", "stop", "first", "place")).alias("places"))
    texts = slim(docs).filter("text <> ''").join(own, "doc_id").dropDuplicates(["doc_id"])
    return by_slice(texts, kernel, "doc_id long, start int, stop int, first long, place int, before string, after string, own binary")


def agreeing(a: str, b: str) -> int:
    """Characters that two texts have in common at their starts."""
    if a == b:
        return len(a)
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def widened(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, start, stop, first) of the anchors whose texts agree, widened as far as both texts do; digests that only collide go."""
    end = (F.col("place") + F.col("stop") - F.col("start")).cast("int")
    there = found.select(F.col("first").alias("doc_id"), F.col("place").alias("start"), end.alias("stop")).distinct()
    theirs = edges(docs, there.withColumn("first", F.col("doc_id")).withColumn("place", F.col("start")))
    theirs = theirs.select("first", "place", F.col("stop").alias("_end"), F.col("before").alias("_before"), F.col("after").alias("_after"), F.col("own").alias("_own"))
    both = edges(docs, found).withColumn("_end", end).join(theirs, ["first", "place", "_end"]).filter("own = _own")

    @F.pandas_udf("int")
    def ahead(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([agreeing(x, y) for x, y in zip(a, b)], dtype="int32")

    @F.pandas_udf("int")
    def back(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([agreeing(x[::-1], y[::-1]) for x, y in zip(a, b)], dtype="int32")

    return both.select("doc_id", (F.col("start") - back("before", "_before")).cast("long").alias("start"), (F.col("stop") + ahead("after", "_after")).cast("long").alias("stop"), "first")


def repeats(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, start, stop, n_chars, first_doc_id, first_doc_ids) of each passage that earlier documents have too; places in code points, stop exclusive.

    Passages that overlap or touch are one, also where they come from several documents: first_doc_ids has them all, first_doc_id the smallest.
    """
    wide = widened(docs, cut(anchors(docs)))
    order = Window.partitionBy("doc_id").orderBy("start", "stop", "first")
    apart = F.coalesce((F.col("start") > F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(0))
    runs = wide.withColumn("_gap", apart).withColumn("_run", F.sum("_gap").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("doc_id", "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("first").alias("first_doc_id"), F.array_sort(F.collect_set("first")).alias("first_doc_ids"))
    return spans.withColumn("n_chars", F.col("stop") - F.col("start")).filter(F.col("n_chars") >= min_chars).select("doc_id", "start", "stop", "n_chars", "first_doc_id", "first_doc_ids")


def remove(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents without the passages that earlier ones have; a document of which nothing but white space stays goes.

    ``n_chars``, where present, follows. Documents without repeats are left as they are.
    """
    spare = (n for i in range(len(docs.columns) + 4) if (n := f"_s{i}") not in docs.columns)
    doc, own, kept = next(spare), next(spare), next(spare)
    spans = repeats(docs, min_chars).groupBy(F.col("doc_id").alias(doc)).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias(own))
    joined = docs.join(spans, F.col("doc_id").cast("long") == F.col(doc), "left")
    # what stands between the spans: from each stop (or 0) to the next start (or the end)
    stops = F.concat(F.array(F.lit(0).cast("long")), F.transform(own, lambda s: s["stop"]))
    starts = F.concat(F.transform(own, lambda s: s["start"]), F.array(F.length("text").cast("long")))
    rest = F.array_join(F.transform(F.arrays_zip(stops.alias("a"), starts.alias("b")), lambda z: F.substring(F.col("text"), (z["a"] + 1).cast("int"), (z["b"] - z["a"]).cast("int"))), "")
    out = joined.withColumn(kept, F.when(F.col(own).isNull(), F.col("text")).otherwise(rest))
    out = out.filter(F.col(own).isNull() | (F.trim(kept) != "")).withColumn("text", F.col(kept))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(own).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
