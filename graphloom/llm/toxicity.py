"""Toxicity by a noisy channel: disguised words (digits and signs for letters, spaced or dotted letters, stretched letters) are
restored by a Viterbi decode of their character lattice under a character language model, and the restored text is scored.

The character model counts letter triples over all training texts (a table of fixed size, summed in Spark). The classifier is
fitted on a documented, bounded sample of labelled documents that aren't held out: words and word beginnings that toxic documents
have far more often than others get a weight, and a logistic curve over a document's weights gives the score. How many toxic
documents must have a feature, and how much likelier it must be there, is chosen by cross-validation within that sample.

Only texts enter a score. Null and empty texts score as texts without evidence. Texts are read whole. Repeated rows give
repeated results; a document with several labels counts with each. Without labels of both kinds every score is the prior.
Other columns are ignored.
"""

from __future__ import annotations

import math
import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import by_slice, cut, slim
from ._text import _LOWER, worker_cache

#: Labelled documents that the classifier is fitted on, at most.
TRAINING_DOCS = 20_000
#: What cross-validation chooses from: toxic documents that a feature must occur in, and how much likelier than elsewhere (log odds) it must be.
SUPPORTS, LEAST_ODDS, FOLDS = (2, 3, 5, 10, 20), (2.0, 3.0, 4.0), 5
#: Disguised words that a worker remembers.
RESTORED = 40_000
#: Characters of a token after which the decode writes out what all its readings agree on.
FLUSH = 256
STEMS = (4, 5, 6)
SYMBOLS = 27  # a to z, and 26 for everything else
# What a disguised character may stand for.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou"}
_SEPARATORS = " .-_*~'`,:/\\"
_WORD = re.compile(r"[^\s]+")
_EDGE = ".,;:!?\"'()[]{}<>|*#$%&-_"
_SPACED = re.compile(r"(?<![^\s.,;:!?\"'(])(?:[A-Za-z0-9@$!|+(€£¡](?:[ .\-_*~]|\s(?=\S(?:\s|$)))){3,}[A-Za-z0-9@$!|+(€£¡](?![A-Za-z0-9])")
_STRETCH = re.compile(r"([a-z])\1\1")
_MASKED = re.compile(r"[a-z][.\-_*~]+[a-z]")
_SIGN = re.compile("[" + re.escape("".join(LOOKS)) + "]")
#: Numbers and amounts, which stay what they are, and words without a letter or a sign that only disguises.
_PLAIN = re.compile(r"[^a-z@!|*¡]*")
#: Signs at an end that the decode may take with or without, counted from the word; the whole run is tried as well.
_NEAR = 4
#: Log costs of the channel: a sign read as a letter, a sign or repeat dropped, a letter kept.
SUBSTITUTE, DROP, REPEAT = -1.0, -0.5, -0.7
_LETTERS = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}


def triples(docs: DataFrame) -> np.ndarray:
    """Log probabilities [two letters before, letter], over all the documents; the table's size is fixed."""
    code = np.full(256, 26, np.int64)
    code[97:123] = np.arange(26)

    def run(batches):
        from ._text import slices

        total = np.zeros(SYMBOLS**3, np.int64)
        for part in slices(batches):
            col = part.column("text")
            off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
            if off[-1] == off[0]:
                continue
            c = code[_LOWER[np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]]]]
            if len(c) > 2:
                inside = np.ones(len(c), bool)  # where a triple starts that ends in the same text
                for back in (1, 2):
                    inside[np.maximum(off[1:] - off[0] - back, 0)] = False
                at = np.flatnonzero(inside[:-2])
                total += np.bincount(c[at] * SYMBOLS**2 + c[at + 1] * SYMBOLS + c[at + 2], minlength=SYMBOLS**3)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SYMBOLS**3)), pa.array(total)], names=["k", "n"])

    rows = slim(docs).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()  # 27^3 rows
    n = np.zeros(SYMBOLS**3)
    n[rows["k"].to_numpy()] = rows["n"].to_numpy()
    n = n.reshape(SYMBOLS**2, SYMBOLS)
    pair = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS).sum(axis=0) + 0.5
    pair /= pair.sum(axis=1, keepdims=True)
    back = np.tile(pair, (SYMBOLS, 1))
    return np.log((n + 20 * back) / (n.sum(axis=1, keepdims=True) + 20))


def restore(token: str, lm: np.ndarray) -> str:
    """The likeliest plain word behind a disguised one: Viterbi over its character lattice, states being the last two letters."""
    states: dict[tuple[int, int], tuple[float, str]] = {(26, 26): (0.0, "")}
    before, done = "", []
    for c in token.lower():
        reads = [(c, 0.0)] if c in _LETTERS else [(r, SUBSTITUTE) for r in LOOKS.get(c, "")]
        skip = None
        if c in _SEPARATORS or (not reads and not c.isalpha()):
            skip = DROP
        elif c == before:
            skip = REPEAT
        if not reads and skip is None:
            reads = [(c, 0.0)]
        new: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (p, word) in states.items():
            if skip is not None and ((a, b) not in new or new[a, b][0] < p + skip):
                new[a, b] = (p + skip, word)
            for r, cost in reads:
                k = _LETTERS.get(r, 26)
                q = p + cost + lm[a * SYMBOLS + b, k]
                if (b, k) not in new or new[b, k][0] < q:
                    new[b, k] = (q, word + r)
        states = new
        before = c
        if len(next(iter(states.values()))[1]) >= FLUSH:
            common = os.path.commonprefix([w for _, w in states.values()])
            done.append(common)
            states = {k: (p, w[len(common) :]) for k, (p, w) in states.items()}
    return "".join(done) + max((p + lm[a * SYMBOLS + b, 26], w) for (a, b), (p, w) in states.items())[1] if states else ""


def disguises(token: str) -> set[str]:
    """The forms of a token that hold a sign which may stand for a letter: signs at its ends may be letters or punctuation, so each is tried as both."""
    if not _SIGN.search(token) or _PLAIN.fullmatch(token):
        return set()
    core = token.strip(_EDGE)
    if not core:
        return {token}
    a = token.index(core)
    b = a + len(core)
    starts = {0, *range(max(0, a - _NEAR), a + 1)} if a else {0}
    ends = {len(token), *range(b, min(len(token), b + _NEAR) + 1)} if b < len(token) else {b}
    # a form starts and ends with the word itself or with a sign that is a letter
    starts = [i for i in starts if i == a or token[i] in LOOKS]
    ends = [j for j in ends if j == b or token[j - 1] in LOOKS]
    return {w for i in starts for j in ends if _SIGN.search(w := token[i:j]) and not _PLAIN.fullmatch(w)}


def readings(text: str, lm: np.ndarray) -> set[str]:
    """A text's plain words in lower case, and what its disguised ones restore to."""
    low = text.lower()
    tokens = set(low.split())
    words = {w.strip(_EDGE) for w in tokens}
    held = worker_cache("restored", dict)
    out = {w for w in words if w}
    odd = {w for w in words if _STRETCH.search(w) or not w.isalpha() and _MASKED.search(w)}
    odd |= {w for t in tokens if not t.isalpha() for w in disguises(t)}
    odd |= {m.group(0) for m in _SPACED.finditer(low)}
    for w in odd:
        if w not in held:
            plain = restore(w, lm)
            # a stretched letter may stand for one or for two
            found = tuple({plain, re.sub(r"(.)\1+", r"\1", plain), re.sub(r"(.)\1{2,}", r"\1\1", plain)})
            if len(held) >= RESTORED:
                held.clear()
            if len(w) <= 64:
                held[w] = found
        else:
            found = held[w]
        out.update(found)
    return out


def features(words: set[str]) -> set[str]:
    return words | {f"{w[:k]}~" for w in words if w.isalpha() for k in STEMS if len(w) > k}


class Model:
    """Weights of words and word beginnings, and a logistic curve over the strongest and the summed evidence."""

    def __init__(self, weights: dict[str, float], curve: np.ndarray, lm: np.ndarray):
        self.weights, self.curve, self.lm = weights, curve, lm

    def evidence(self, text: str) -> tuple[float, float]:
        words = readings(text, self.lm)
        own = []
        for w in words:
            best = self.weights.get(w, 0.0)
            if w.isalpha():
                for k in STEMS:
                    if len(w) > k and (v := self.weights.get(f"{w[:k]}~", 0.0)) > best:
                        best = v
            if best:
                own.append(best)
        return (max(own), sum(own)) if own else (0.0, 0.0)

    def score(self, text: str) -> float:
        top, total = self.evidence(text)
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, self.curve @ np.array([1.0, top, math.log1p(total)]))))))


def held_out(column="doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0




def fit(docs: DataFrame, labels: DataFrame, training_docs: int = TRAINING_DOCS) -> Model:
    """The model from labelled documents that aren't held out; ``training_docs`` of them at most, chosen by a hash of their ids."""
    d = slim(docs)
    lm = triples(d.filter(~held_out()))
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null").filter(~held_out())
    chosen = own.distinct().orderBy(F.xxhash64("doc_id", F.lit(7)), "toxic").limit(training_docs)
    train = cut(d.join(F.broadcast(chosen), "doc_id").withColumn("_copy", F.xxhash64("text")).dropDuplicates(["_copy", "toxic"]))
    table = d.sparkSession.sparkContext.broadcast(lm)

    def count(part):
        n: dict[str, list[int]] = {}
        for t, y in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
            for f in features(readings(t, table.value)):
                n.setdefault(f, [0, 0])[1 if y else 0] += 1
        return {"f": pa.array(list(n), pa.string()), "c0": pa.array([v[0] for v in n.values()], pa.int64()), "c1": pa.array([v[1] for v in n.values()], pa.int64())} if n else None

    sizes = {bool(r["toxic"]): r["count"] for r in train.groupBy("toxic").count().collect()}
    n0, n1 = sizes.get(False, 0), sizes.get(True, 0)
    prior = math.log((n1 + 0.5) / (n0 + 0.5)) if n0 + n1 else -2.0
    flat = Model({}, np.array([min(prior, -0.1) if n0 + n1 == 0 or not n0 * n1 else prior, 0.0, 0.0]), lm)
    if not n0 * n1:
        return flat
    counts = by_slice(train, count, "f string, c0 long, c1 long").groupBy("f").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    odds = F.log((F.col("c1") + 0.2) / (n1 + 0.4)) - F.log((F.col("c0") + 0.2) / (n0 + 0.4))
    names = [r["f"] for r in counts.filter((F.col("c1") >= min(SUPPORTS)) & (odds >= min(LEAST_ODDS) - 1)).select("f").orderBy("f").collect()]  # of training_docs documents
    number = d.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def describe(part):
        """The candidate features of each document, word by word: a word and its beginnings, and -1 after each."""
        out = []
        for t in part.column("text").to_pylist():
            own = []
            for w in sorted(readings(t, table.value)):
                have = [number.value[f] for f in (w, *(f"{w[:k]}~" for k in STEMS if w.isalpha() and len(w) > k)) if f in number.value]
                if have:
                    own += [*have, -1]
            out.append(own)
        return {"copy": part.column("_copy"), "toxic": part.column("toxic").cast(pa.int32()), "own": pa.array(out, pa.list_(pa.int64()))}

    seen = by_slice(train, describe, "copy long, toxic int, own array<long>").toPandas().sort_values(["copy", "toxic"], ignore_index=True)  # training_docs rows at most
    sample = Sample(seen["own"].tolist(), seen["toxic"].to_numpy() > 0, len(names))
    support, least = sample.choose()
    w = sample.weights(np.ones(len(seen), bool), support, least)
    return Model({f: float(x) for f, x in zip(names, w) if x > 0}, sample.curve(sample.evidence(w), np.ones(len(seen), bool)), lm)


class Sample:
    """Training documents by their candidate features, for cross-validation in memory."""

    def __init__(self, own: list[np.ndarray], toxic: np.ndarray, features: int):
        self.toxic, self.features = toxic, features
        flat = np.concatenate([np.asarray(x, np.int64) for x in own]) if len(own) else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(own)), [len(x) for x in own])
        ends = flat < 0
        word = np.cumsum(ends) - ends
        self.flat, self.doc, self.word = flat[~ends], doc[~ends], word[~ends]
        self.word_doc = doc[ends]
        pairs = np.unique(np.stack([self.doc, self.flat], axis=1), axis=0) if len(self.flat) else np.zeros((0, 2), np.int64)
        self.pair_doc, self.pair_feature = pairs[:, 0], pairs[:, 1]
        self.fold = np.arange(len(own)) % FOLDS  # documents stand in the order of a hash

    def weights(self, rows: np.ndarray, support: int, least: float) -> np.ndarray:
        """Log odds of each feature over the given documents; 0 where it is too rare or not much likelier."""
        have = rows[self.pair_doc]
        toxic = self.toxic[self.pair_doc]
        c1 = np.bincount(self.pair_feature[have & toxic], minlength=self.features)
        c0 = np.bincount(self.pair_feature[have & ~toxic], minlength=self.features)
        n1, n0 = int((rows & self.toxic).sum()), int((rows & ~self.toxic).sum())
        w = np.log((c1 + 0.2) / (n1 + 0.4)) - np.log((c0 + 0.2) / (n0 + 0.4))
        return np.where((c1 >= support) & (w >= least), w, 0.0)

    def evidence(self, w: np.ndarray) -> np.ndarray:
        """(1, strongest, log of 1 + sum) of each document, each word counting by its best feature."""
        best = np.zeros(len(self.word_doc))
        np.maximum.at(best, self.word, w[self.flat])
        top, total = np.zeros(len(self.toxic)), np.bincount(self.word_doc, best, len(self.toxic))
        np.maximum.at(top, self.word_doc, best)
        return np.stack([np.ones(len(self.toxic)), top, np.log1p(total)], axis=1)

    def curve(self, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Logistic regression by Newton's method, with a little shrinkage."""
        x, y = x[rows], self.toxic[rows].astype(float)
        out = np.array([math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), 0.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ out, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3), x.T @ (y - p) - 0.1 * out)
            out = out + step
            if np.abs(step).max() < 1e-6:
                break
        return out

    def choose(self) -> tuple[int, float]:
        """The support and the least log odds with the best likelihood of documents left out; ties go to the stricter."""
        best = (-math.inf, 0, 0.0)
        for support in SUPPORTS:
            for least in LEAST_ODDS:
                total = 0.0
                for k in range(FOLDS):
                    rows = self.fold != k
                    x = self.evidence(self.weights(rows, support, least))
                    p = 1 / (1 + np.exp(-np.clip(x[~rows] @ self.curve(x, rows), -30, 30)))
                    y = self.toxic[~rows]
                    total += float(np.log(np.where(y, p, 1 - p)).sum())
                best = max(best, (round(total, 9), support, least))
        return best[1], best[2]


def assess(docs: DataFrame, labels: DataFrame, training_docs: int = TRAINING_DOCS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, training_docs))

    def kernel(part):
        s = [held.value.score(t) for t in part.column("text").to_pylist()]
        return {"doc_id": part.column("doc_id"), "score": pa.array(s, pa.float64())}

    scored = by_slice(slim(docs), kernel, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, training_docs: int = TRAINING_DOCS) -> DataFrame:
    """The documents that score below a half; null texts stay."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, training_docs))

    @F.pandas_udf("double")
    def score(texts):
        return texts.map(lambda t: held.value.score(t or "")).astype(float)

    return docs.filter(score("text") < 0.5)
