"""Language-model scoring with a gated recurrent network: numpy, truncated backpropagation, class-factored output.

Three things are gathered from all training documents in Spark: the counts of their words, by 64-bit word hash; how often each
pair of neighbouring letters occurs in a word behind a word of each ending; and, once words have classes, the tokens of each
class. The pair table (of fixed size) is factored into ``GROUPS`` groups, which come out as languages and kinds of text, and
gives every word a group by its letters, words never seen included. The ``FREQUENT`` most frequent words are split into
classes by group and frequency; all other words fall into a tail class for each group.

A word's probability is that of its class given the state, times that of the word in its class: a softmax given the state for
frequent words, its share of the class's training tokens for tail words (unseen words share one token's place). ``UNIGRAM``
of the corpus's unigram distribution is mixed in for each word. The state is carried across windows from a document's first
word to its end, so the score is that of the complete document.

Documents are encoded once, to two bytes a token. Training documents are dealt to shards by a hash; there is a shard for every
``SHARD`` tokens of the corpus, whatever the cluster. In each of ``len(RATES)`` rounds every shard trains from the common
weights on its share of the round's documents, in hash order, and the shards' weights are averaged by tokens: every training
document is trained on once, and neither partitioning nor the number of executors enters (but for rounding). Counts of the
``TABLE`` most frequent words travel to the tasks; the rarer words of a document meet their counts in a join.

Null and empty texts have one token, the end. Null ids are training documents. Repeated rows are repeated training text and
give repeated results. Very long texts are trained on in pieces of ``PIECE`` tokens and scored whole. Empty tables give empty
results. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut, slim
from ._text import Words, mapped, mix, slices

FREQUENT, WIDTH = 2048, 64  # frequent words, words of a class
GROUPS = TAILS = 16
HIDDEN = 24
#: Words whose counts travel to the tasks, at most.
TABLE = 1 << 19
LANES, STEPS, PIECE = 320, 32, 1024
#: Training tokens of a shard, about; tokens that are handled at a time.
SHARD, BUFFER = 2_000_000, 1_500_000
LONG = 64  # letter pairs of words that are gone through place by place
UNIGRAM = 0.02
RATES = (6e-3, 5e-3, 4e-3, 2e-3, 1e-3)
END = int(mix(np.array([0xE0D], np.uint64))[0])
_CLASSES = FREQUENT // WIDTH
_IDS = FREQUENT + TAILS  # the end and the start of a text are tokens like others
_SYMBOL = np.full(256, 27, np.uint8)  # a to z, digits, other signs, and four kinds of bytes of other characters
_SYMBOL[97:123], _SYMBOL[48:58], _SYMBOL[128:] = np.arange(26), 26, 28 + np.arange(128) % 4
_PAIRS = 32 * 32


def held_out(column="doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _tokens(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with an end after each text's words, the places of the words among them, and the texts' bounds."""
    at = np.concatenate([[0], np.cumsum(w.count + 1)])
    out = np.full(at[-1], END, np.uint64)
    place = np.arange(len(w.start)) + w.doc
    out[place] = w.hashes()
    return out, place, at


def _letter_pairs(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Codes of neighbouring symbols inside the given words, word by word; one symbol alone is a pair with itself."""
    size = np.maximum(end - start - 1, 1)
    at = np.arange(int(size.sum())) + np.repeat(start - np.cumsum(size) + size, size)
    return s[at] * np.int32(32) + s[np.minimum(at + 1, np.repeat(end - 1, size))]


def _neighbours(w: Words) -> np.ndarray:
    """Codes of letter pairs and the ending of the word before, for every letter pair of words that have one before them in their text."""
    s = mapped(w.data, _SYMBOL)
    ending = s[np.maximum(w.end - 2, w.start)] * np.int32(32) + s[w.end - 1]
    follows = np.append(False, w.doc[1:] == w.doc[:-1])
    one = w.end - w.start == 1
    inside = ~(w.ws[1:] | w.ws[:-1])  # this place and the next are in one word
    edge = w.off[(w.off > 0) & (w.off < len(s))]
    inside[edge - 1] = False
    lead = np.flatnonzero(~follows & ~one)  # texts' first words
    size = w.end[lead] - w.start[lead] - 1
    inside[np.arange(int(size.sum())) + np.repeat(w.start[lead] - np.cumsum(size) + size, size)] = False
    code = (s[:-1] * np.int32(32) + s[1:])[inside]
    code *= _PAIRS
    before = np.append(np.int32(0), ending[:-1])
    code += np.repeat(before, np.where(follows, w.end - w.start - 1, 0))
    single = np.flatnonzero(follows & one)
    return np.concatenate([code, s[w.start[single]] * np.int32(33 * _PAIRS) + before[single]])


def gather(docs: DataFrame) -> DataFrame:
    """(kind, word, n) over all given documents: word counts, ends included (kind 0), and letter pairs behind a word of each ending (kind 1)."""

    def run(batches):
        pairs, held, size = np.zeros(_PAIRS * _PAIRS, np.int64), [], 0

        def out():
            u, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(u), np.int8)), pa.array(u.astype(np.int64)), pa.array(n)], names=["kind", "word", "n"])

        for part in slices(batches):
            w = Words(part.column("text"), lower=True)
            held.append(_tokens(w)[0])
            size += len(held[-1])
            if len(w.start):
                pairs += np.bincount(_neighbours(w), minlength=len(pairs))
            if size >= 3 * BUFFER:
                yield out()
                held, size = [], 0
        if held:
            yield out()
        k = np.flatnonzero(pairs)
        if len(k):
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(k), np.int8)), pa.array(k), pa.array(pairs[k])], names=["kind", "word", "n"])

    return slim(docs).mapInArrow(run, "kind byte, word long, n long").groupBy("kind", "word").agg(F.sum("n").alias("n"))


def factor(pairs: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Log weights of groups, and log probabilities [letter pair, group], by EM on the table of pairs and endings (a mixture of products)."""
    if not pairs.sum():
        return np.zeros(GROUPS), np.zeros((_PAIRS, GROUPS))
    rng = np.random.default_rng(0)
    y = (pairs / pairs.sum()).astype(np.float32)
    a = y.sum(axis=1, keepdims=True) * rng.uniform(0.5, 1.5, (_PAIRS, GROUPS)).astype(np.float32)
    b = y.sum(axis=0) * rng.uniform(0.5, 1.5, (GROUPS, _PAIRS)).astype(np.float32)
    b /= b.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        ratio = y / (a @ b + np.float32(1e-12))
        a, b = a * (ratio @ b.T), b * (a.T @ ratio)
        b /= b.sum(axis=1, keepdims=True) + np.float32(1e-12)
    weight = a.sum(axis=0, dtype=np.float64) + 1e-9
    p = a + 1e-7
    return np.log(weight / weight.sum()), np.log(p / p.sum(axis=0))


class Table:
    """The bounded part of the vocabulary: hashes in order with their counts, the totals, groups by letters, and ids of frequent words."""

    def __init__(self, words: np.ndarray, n: np.ndarray, tokens: int, distinct: int, groups: tuple[np.ndarray, np.ndarray]):
        o = np.argsort(words)
        self.words, self.n = words[o], n[o]
        self.tokens, self.distinct = tokens, distinct
        self.whole = distinct <= len(words)  # every word is here: others were never seen
        self.weight, self.pair = groups[0].astype(np.float32), np.ascontiguousarray(groups[1].astype(np.float32))
        top = np.lexsort((self.words, -self.n))[:FREQUENT]
        self.ids = np.full(len(self.words), -1, np.int32)  # of frequent words, by frequency
        self.ids[top] = np.arange(len(top))
        self.frequent, self.tail = np.zeros(FREQUENT), np.zeros(TAILS)
        self.frequent[: len(top)] = self.n[top]
        self.order, self.end = np.arange(_IDS), FREQUENT
        at, there = self.find(np.array([END], np.uint64))
        if there[0] and self.ids[at[0]] >= 0:
            self.end = int(self.ids[at[0]])

    def settle(self, group: np.ndarray) -> None:
        """Output places of the ids: frequent words stand by group and then by frequency."""
        m = int((self.frequent > 0).sum())
        o = np.argsort(group[:m], kind="stable")
        self.order[o] = np.arange(m)
        self.frequent[:m] = self.frequent[:m][o]
        self.end = int(self.order[self.end])

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash in the table, and whether it is there."""
        if not len(self.words):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return at, self.words[at] == h

    def group_of(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The likeliest group of each word, by its letter pairs."""
        if not len(start):
            return np.zeros(0, np.int64)
        s = mapped(data, _SYMBOL)
        size = np.maximum(end - start - 1, 1)
        out = np.zeros(len(start), np.int64)
        order = np.argsort(-np.minimum(size, LONG + 1).astype(np.int16), kind="stable")  # the longest first
        long, order = np.split(order, [int((size > LONG).sum())])
        if len(long):
            out[long] = self._group_of_long(s, start[long], end[long])
        at, last = start[order], end[order] - 1
        total = np.tile(self.weight, (len(order), 1))
        for live in np.searchsorted(-size[order], -np.arange(int(size[order[:1]].sum())), "left").tolist():  # words that have so many pairs
            at, last = at[:live], last[:live]
            at = at + 1
            total[:live] += np.take(self.pair, s[at - 1] * np.int32(32) + s[np.minimum(at, last)], axis=0)
        out[order] = total.argmax(axis=1)
        return out

    def _group_of_long(self, s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The same group by group, for words whose places would be too many steps."""
        code = _letter_pairs(s, start, end)
        first = np.append(0, np.cumsum(end - start - 1)[:-1])
        best = np.full(len(start), -np.inf, np.float32)
        out = np.zeros(len(start), np.int64)
        for g in range(GROUPS):
            total = np.add.reduceat(self.pair[:, g][code], first) + self.weight[g]
            better = total > best
            best[better], out[better] = total[better], g
        return out


def table(counts: DataFrame) -> Table:
    """From what was gathered; what comes to the driver is bounded by TABLE, the pair table and a histogram of counts by magnitude."""
    words = counts.filter("kind = 0")
    magnitude = F.floor(F.log2("n") * 16).cast("int")
    total = {r["m"]: (r["n"], r["v"]) for r in words.groupBy(magnitude.alias("m")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}  # 64 * 16 rows at most
    room, least = TABLE, 1 << 20
    for m in sorted(total, reverse=True):
        room -= total[m][1]
        if room < 0:
            break
        least = m
    rows = words.filter(magnitude >= least).select("word", "n").toPandas()
    cells = counts.filter("kind = 1").select("word", "n").toPandas()  # _PAIRS ** 2 rows at most
    pairs = np.zeros(_PAIRS * _PAIRS)
    pairs[cells["word"].to_numpy(np.int64)] = cells["n"].to_numpy()
    return Table(rows["word"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64), sum(int(n) for n, _ in total.values()), sum(int(v) for _, v in total.values()), factor(pairs.reshape(_PAIRS, _PAIRS)))


def encode(docs: DataFrame, t) -> DataFrame:
    """Every document as ids of two bytes, with its sums over counts and the words whose counts are not in the table.

    ids: of frequent words their own, of others FREQUENT and the tail class. Rows of ``stat`` 1 and 2 give the training tokens of
    each tail class, and the groups of frequent words.
    """

    def run(batches):
        voc = t.value
        log1, log0 = np.log10(voc.n + 1.0), np.log10(np.maximum(voc.n, 1.0))
        tails, tops = np.zeros(TAILS, np.int64), np.full(FREQUENT, -1, np.int64)

        def rows(stat, doc_id, key, learn, n, known, base, model, words, times, ids):
            return pa.RecordBatch.from_arrays([stat, doc_id, key, learn, n, known, base, model, words, times, ids], names=["stat", "doc_id", "key", "learn", "n_tokens", "known", "base", "model", "words", "times", "ids"])

        for part in slices(batches, limit=3 << 20):
            w = Words(part.column("text"), lower=True)
            h, place, at = _tokens(w)
            o = np.argsort(h)
            new = np.append(True, h[o[1:]] != h[o[:-1]])
            first = o[new]  # a place of each distinct hash
            u, which = h[first], np.empty(len(h), np.int64)
            which[o] = np.cumsum(new) - 1
            word = np.full(len(h), -1, np.int64)
            word[place] = np.arange(len(place))
            own = word[first]  # a word of the slice for each distinct hash, -1 for the end
            real = own >= 0
            spot, there = voc.find(u)
            group = np.zeros(len(u), np.int64)
            group[real] = voc.group_of(w.data, w.start[own[real]], w.end[own[real]])
            rank = voc.ids[spot] if len(voc.ids) else np.full(len(u), -1)
            frequent = there & (rank >= 0)
            ids = np.where(frequent, rank, FREQUENT + group)
            tops[ids[frequent]] = group[frequent]
            l1, l0 = np.where(there, log1[spot] if len(log1) else 0.0, 0.0), np.where(there & ~frequent, log0[spot] if len(log0) else 0.0, 0.0)
            y = ids[which]
            per = lambda x: np.add.reduceat(x, at[:-1])
            learn = part.column("learn").to_numpy(zero_copy_only=False)
            tails += np.bincount(y[np.repeat(learn, np.diff(at)) & (y >= FREQUENT)] - FREQUENT, minlength=TAILS)
            missing = np.flatnonzero((~there)[which]) if not voc.whole else np.zeros(0, np.int64)
            doc = np.searchsorted(at, missing, "right") - 1
            o = np.lexsort((which[missing], doc))
            doc, kind = doc[o], which[missing][o]
            new = np.append(True, (doc[1:] != doc[:-1]) | (kind[1:] != kind[:-1])) if len(doc) else np.zeros(0, bool)
            lead = np.flatnonzero(new)
            ends = pa.array(np.searchsorted(doc[lead], np.arange(len(part) + 1)).astype(np.int32))
            raw = y.astype("<u2").tobytes()
            yield rows(
                pa.array(np.zeros(len(part), np.int8)), part.column("doc_id"), part.column("key"), part.column("learn"), pa.array(np.diff(at)), pa.array(per(there[which].astype(np.int64))), pa.array(per(l1[which])), pa.array(per(l0[which])),
                pa.ListArray.from_arrays(ends, pa.array(u[kind[lead]].astype(np.int64))), pa.ListArray.from_arrays(ends, pa.array(np.diff(np.append(lead, len(doc))).astype(np.int64))),
                pa.array([raw[2 * a : 2 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary()),
            )
        for stat, k, n in ((1, np.arange(TAILS), tails), (2, np.flatnonzero(tops >= 0), tops[tops >= 0])):
            m, zero = len(k), pa.array(np.zeros(len(k)))
            none = pa.ListArray.from_arrays(pa.array(np.zeros(m + 1, np.int32)), pa.array([], pa.int64()))
            yield rows(pa.array(np.full(m, stat, np.int8)), pa.array(k), pa.array(k), pa.array(np.zeros(m, bool)), pa.array(n), pa.array(n), zero, zero, none, none, pa.array([b""] * m, pa.binary()))

    d = slim(docs).withColumn("key", F.xxhash64("doc_id", "text")).withColumn("learn", ~held_out())
    return d.mapInArrow(run, "stat byte, doc_id long, key long, learn boolean, n_tokens long, known long, base double, model double, words array<long>, times array<long>, ids binary")


class Network:
    """Weights of the recurrent network and the class-factored output; 32-bit floats.

    ``X`` has each id's input to the gates (update, reset, candidate): its embedding, seen through the gates' input weights. Gates
    are hard sigmoids. Features come before lanes in memory, so that each gate is one block.
    """

    SHAPES = {"X": (3 * HIDDEN, _IDS), "Wh": (3 * HIDDEN, HIDDEN), "Wc": (HIDDEN, _CLASSES + TAILS), "bc": (_CLASSES + TAILS,), "Ww": (_CLASSES, HIDDEN, WIDTH), "bw": (_CLASSES, WIDTH)}
    SLOPE = 0.25

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat, 0
        for k, shape in self.SHAPES.items():
            n = math.prod(shape)
            setattr(self, k, flat[at : at + n].reshape(shape))
            at += n

    @classmethod
    def size(cls) -> int:
        return sum(map(math.prod, cls.SHAPES.values()))

    @classmethod
    def start(cls, t: Table) -> "Network":
        """Small random weights; biases are the log frequencies of classes and of words in them."""
        rng = np.random.default_rng(1)
        net = cls(np.zeros(cls.size(), np.float32))
        net.X[:] = rng.normal(0, 0.3, net.X.shape)
        net.X[:HIDDEN] += 0.5  # states begin by lasting
        net.Wh[:] = rng.normal(0, 1 / math.sqrt(HIDDEN), net.Wh.shape)
        net.Wc[:] = rng.normal(0, 0.05, net.Wc.shape)
        net.Ww[:] = rng.normal(0, 0.02, net.Ww.shape)
        n = t.frequent.reshape(_CLASSES, WIDTH)
        mass = np.concatenate([n.sum(axis=1) + 1e-3, t.tail + 1])
        net.bc[:] = np.log(mass / mass.sum())
        net.bw[:] = np.log((n + 1e-6) / (n + 1e-6).sum(axis=1, keepdims=True))
        return net

    def _scaled(self, dtype) -> tuple[np.ndarray, np.ndarray]:
        """Inputs and recurrent weights with the hard sigmoids' slope, and half of one for the inputs' gates, put in."""
        k = 2 * HIDDEN
        scale = np.ones((3 * HIDDEN, 1), dtype)
        scale[:k] = self.SLOPE
        inputs = self.X * scale
        inputs[:k] += 0.5
        return inputs, self.Wh * scale

    def states(self, ids: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """States [steps, HIDDEN, lanes] after each step, from the steps' input ids and a state [HIDDEN, lanes]; ``fresh``: the step starts a document.

        They lie in memory as [HIDDEN, steps, lanes]. All else is done a step at a time, which stays in a core's cache.
        """
        k = 2 * HIDDEN
        inputs, wh = self._scaled(h.dtype)
        steps, m = ids.shape
        out = np.empty((HIDDEN, steps, m), inputs.dtype)
        own = steps if keep is not None else 1
        gates, candidate, inner = (np.empty((own, n, m), out.dtype) for n in (k, HIDDEN, HIDDEN))
        before = np.empty_like(out) if keep is not None else None
        g, turns = np.empty((3 * HIDDEN, m), out.dtype), np.empty((2, HIDDEN, m), out.dtype)
        begins = fresh.any(axis=1)
        for t in range(steps):
            i = t if keep is not None else 0
            if begins[t]:
                h = h * ~fresh[t]
            x = np.take(inputs, ids[t], axis=1)
            np.dot(wh, h, out=g)
            zr, n = gates[i], candidate[i]
            np.add(x[:k], g[:k], out=zr)
            np.clip(zr, 0, 1, out=zr)
            np.multiply(zr[HIDDEN:], g[k:], out=n)
            n += x[k:]
            np.tanh(n, out=n)
            if keep is not None:
                inner[t] = g[k:]
                before[:, t] = h
            new = np.subtract(h, n, out=turns[t % 2])
            new *= zr[:HIDDEN]
            new += n
            out[:, t] = h = new
        if keep is not None:
            keep |= {"gates": gates, "candidate": candidate, "inner": inner, "before": before, "wh": wh}
        return out.transpose(1, 0, 2)

    def output(self, h: np.ndarray, y: np.ndarray, grad: "Network | None" = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probability of each target (of its class, for tail words) given states [rows, HIDDEN]; with ``grad``, adds gradients of the negative sum."""
        cls = np.where(y < FREQUENT, y // WIDTH, _CLASSES + y - FREQUENT)
        order = np.argsort(cls.astype(np.uint8), kind="stable")
        y, cls = y[order], cls[order]
        edge = np.searchsorted(cls, np.arange(_CLASSES + 1)).tolist()
        own = np.ones((HIDDEN + 1, len(y)), h.dtype)  # the last feature is 1, its weights are the biases
        np.take(h.T, order, axis=1, out=own[:HIDDEN], mode="clip")
        logp, dh = np.empty(len(y), h.dtype), np.empty((HIDDEN, len(y)), h.dtype) if grad is not None else None
        # states lie within [-1, 1], so no logit is above 0
        wc = np.concatenate([self.Wc, (self.bc - (np.abs(self.Wc).sum(axis=0) + self.bc).max())[None]])
        ww = np.concatenate([self.Ww, (self.bw - (np.abs(self.Ww).sum(axis=1) + self.bw).max(axis=1)[:, None])[:, None]], axis=1)
        jobs = [(a, min(a + 2048, len(y)), cls, wc, None) for a in range(0, len(y), 2048)]
        word = y % WIDTH
        jobs += [(edge[c], edge[c + 1], word, ww[c], c) for c in range(_CLASSES) if edge[c] < edge[c + 1]]
        rows = np.arange(len(y))
        ones = np.ones(max(WIDTH, _CLASSES + TAILS), h.dtype)
        for a, b, targets, weight, c in jobs:
            x = own[:, a:b]
            logit = x.T @ weight
            place = rows[: b - a] * logit.shape[1]
            place += targets[a:b]
            flat = logit.reshape(-1)
            hit = flat[place]
            p = np.exp(logit, out=logit)
            total = p @ ones[: p.shape[1]]
            hit -= np.log(total)
            if c is None:
                logp[a:b] = hit
            else:
                logp[a:b] += hit
            if grad is not None:  # p stays a multiple of the probabilities; the sums are divided out of what is narrower
                flat[place] -= total
                part = 1 / total
                g = (x * part) @ p
                gw, gb = (grad.Wc, grad.bc) if c is None else (grad.Ww[c], grad.bw[c])
                gw += g[:-1]
                gb += g[-1]
                back = weight[:-1] @ p.T
                back *= part
                if c is None:
                    dh[:, a:b] = back
                else:
                    dh[:, a:b] += back
        back = np.empty_like(order)
        back[order] = rows
        return logp[back], np.take(dh, back, axis=1).T if grad is not None else None

    def gradient(self, ids, fresh, h0, y, valid, grad: "Network") -> np.ndarray:
        """Adds the window's gradients, by backpropagation to its first step; gives the state after it."""
        keep: dict = {}
        states = self.states(ids, fresh, h0, keep)
        steps, m = ids.shape
        every = states.transpose(1, 0, 2).reshape(HIDDEN, -1)
        if valid.all():
            dout = self.output(every.T, y.ravel(), grad)[1].T
        else:
            on = np.flatnonzero(valid.ravel())
            dout = np.zeros_like(every)
            dout[:, on] = self.output(np.take(every, on, axis=1).T, y.ravel()[on], grad)[1].T
        dout = dout.reshape(HIDDEN, steps, m)
        k = 2 * HIDDEN
        before = keep["before"]
        # what the arguments of update gate, reset gate, recurrent part of the candidate and candidate add to the loss, without the slope
        dg = np.empty((4 * HIDDEN, steps, m), states.dtype)
        begins = fresh.any(axis=1)
        wt = np.ascontiguousarray(keep["wh"].T)
        dh, back, held = np.zeros((HIDDEN, m), states.dtype), np.empty((HIDDEN, m), states.dtype), np.empty((HIDDEN, m), states.dtype)
        own = np.empty((4 * HIDDEN, m), states.dtype)
        to_z, to_r, inner, dn = (own[i : i + HIDDEN] for i in range(0, 4 * HIDDEN, HIDDEN))
        for t in range(steps - 1, -1, -1):
            zr, n = keep["gates"][t], keep["candidate"][t]
            z, r = zr[:HIDDEN], zr[HIDDEN:]
            dh += dout[:, t]
            np.subtract(before[:, t], n, out=to_z)
            to_z *= dh
            np.multiply(dh, z, out=held)
            np.subtract(dh, held, out=dh)
            np.multiply(n, n, out=dn)
            dn *= dh
            np.subtract(dh, dn, out=dn)
            np.multiply(dn, keep["inner"][t], out=to_r)
            np.multiply(dn, r, out=inner)
            own[:k] *= (zr > 0) & (zr < 1)
            dg[:, t] = own
            np.dot(wt, own[: 3 * HIDDEN], out=back)
            dh = np.add(held, back, out=dh)
            if begins[t]:
                dh *= ~fresh[t]
        dg = dg.reshape(4 * HIDDEN, -1)
        wh = dg[: 3 * HIDDEN] @ before.reshape(HIDDEN, -1).T
        wh[:k] *= self.SLOPE
        grad.Wh += wh
        place = ids.ravel()
        dg[:k] *= self.SLOPE
        for f in range(3 * HIDDEN):
            np.add.at(grad.X[f], place, dg[f if f < k else f + HIDDEN])
        return states[-1]


class Trainer:
    """Adam on a network's weights."""

    def __init__(self, flat: np.ndarray, rate: float):
        self.net, self.rate, self.k = Network(flat), rate, 0
        self.grad = Network(np.zeros_like(flat))
        self.m, self.v, self.held = np.zeros_like(flat), np.zeros_like(flat), np.empty_like(flat)

    def step(self, ids, fresh, state, y, valid) -> np.ndarray:
        g = self.grad.flat
        g[:] = 0
        state = self.net.gradient(ids, fresh, state, y, valid, self.grad)
        self.k += 1
        g *= 1 / max(1, int(valid.sum()))
        self.m *= 0.9
        self.m += np.multiply(g, 0.1, out=self.held)
        self.v *= 0.99
        g *= g
        self.v += np.multiply(g, 0.01, out=self.held)
        np.sqrt(self.v, out=self.held)
        self.held += 1e-6
        np.divide(self.m, self.held, out=self.held)
        self.held *= self.rate * math.sqrt(1 - 0.99**self.k) / (1 - 0.9**self.k)
        self.net.flat -= self.held
        return state


def lanes(lengths: np.ndarray, n: int) -> list[list[int]]:
    """Texts dealt to at most n lanes of about equal length, the longest lane first."""
    heap = [(0, i) for i in range(max(1, min(n, len(lengths))))]
    out: list[list[int]] = [[] for _ in heap]
    total = [0] * len(heap)
    for d in np.argsort(-lengths, kind="stable").tolist():
        size, i = heapq.heappop(heap)
        out[i].append(d)
        total[i] = size + int(lengths[d])
        heapq.heappush(heap, (total[i], i))
    return [out[i] for i in sorted(range(len(out)), key=lambda i: -total[i])]


def windows(at: np.ndarray, steps: int, n: int):
    """Windows (places [steps, lanes] or -1, is a text's first token) over texts' tokens; lanes that have ended drop out."""
    own = lanes(np.diff(at), n)
    size = np.array([sum(int(at[d + 1] - at[d]) for d in docs) for docs in own], np.int64)
    run = np.concatenate([np.arange(at[d], at[d + 1]) for docs in own for d in docs] or [np.zeros(0, np.int64)])
    end = np.cumsum(size)
    first = np.zeros(at[-1], bool)
    first[at[:-1][np.diff(at) > 0]] = True
    for t in range(0, int(size[0]) if len(size) else 0, steps):
        live = int((size > t).sum())
        spot = np.arange(t, min(t + steps, int(size[0])))[:, None] + (end - size)[:live]
        on = spot < end[:live]
        if on.all():
            place = run[spot]
            yield place, first[place]
        else:
            place = np.where(on, run[np.minimum(spot, len(run) - 1)], -1)
            yield place, first[place] & on


def _inputs(y: np.ndarray, at: np.ndarray, end: int) -> np.ndarray:
    """The id before each token; before a text's first one, that of an end."""
    before = np.append(end, y[:-1])
    before[at[:-1]] = end
    return before


def train(dealt: DataFrame, parts: int, voc: Table, weights: np.ndarray, k: int) -> np.ndarray:
    """The weights after round ``k``: those of all shards, averaged by tokens. dealt: (shard, key, ids), by shard and key in each partition."""
    sc = dealt.sparkSession.sparkContext
    held = sc.broadcast(weights)
    end, order, rate = voc.end, voc.order, RATES[k]

    def run(batches):
        n, total = 0, None

        def shard(texts: list[bytes]):
            y = order[np.frombuffer(b"".join(texts), "<u2")]
            size = np.array([len(x) // 2 for x in texts])
            whole = np.concatenate([[0], np.cumsum(size)])
            at = np.union1d(whole, np.concatenate([np.arange(a, b, PIECE) for a, b in zip(whole[:-1], whole[1:])]))
            before = _inputs(y, whole, end)
            trainer = Trainer(held.value.copy(), rate)
            state, seen = np.zeros((HIDDEN, LANES), np.float32), 0
            for place, fresh in windows(at, STEPS, LANES):
                valid = place >= 0
                state = trainer.step(before[place], fresh, state[:, : place.shape[1]], y[place], valid)
                seen += int(valid.sum())
            return seen, trainer.net.flat

        own, texts = None, []
        for b in batches:
            for s, x in zip(b.column("shard").to_pylist(), b.column("ids").to_pylist()):
                if s != own and texts:
                    seen, flat = shard(texts)
                    n, total, texts = n + seen, flat * float(seen) if total is None else total + flat * float(seen), []
                own = s
                texts.append(x)
        if texts:
            seen, flat = shard(texts)
            n, total = n + seen, flat * float(seen) if total is None else total + flat * float(seen)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], names=["n", "w"])

    def add(batches):
        n, total = 0, None
        for b in batches:
            for k, w in zip(b.column("n").to_pylist(), b.column("w").to_pylist()):
                w = np.frombuffer(w, np.float32) * float(k)
                total = w if total is None else total + w
                n += k
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], names=["n", "w"])

    out = dealt.filter(F.pmod(F.xxhash64("key", F.lit(3)), F.lit(len(RATES))) == k).select("shard", "ids").mapInArrow(run, "n long, w binary")
    while parts > 8:  # means of means, so that neither a task nor the driver reads very many
        parts = max(8, parts // 16)
        out = out.repartition(parts).mapInArrow(add, "n long, w binary")
    rows = out.collect()
    if not rows:
        return weights
    n = np.array([r["n"] for r in rows], float)
    return sum(np.frombuffer(r["w"], np.float32) * (x / n.sum()) for r, x in zip(rows, n)).astype(np.float32)


def fit(docs: DataFrame) -> tuple[DataFrame, Table, np.ndarray, DataFrame]:
    """Word counts, the table, the network's weights, and all documents encoded."""
    sc = docs.sparkSession.sparkContext
    counts = cut(gather(docs.filter(~held_out())))
    voc = table(counts)
    encoded = cut(encode(docs, sc.broadcast(voc)))
    group = np.zeros(FREQUENT, np.int64)
    for r in encoded.filter("stat > 0").groupBy("stat", "doc_id").agg(F.sum("n_tokens").alias("n"), F.max("n_tokens").alias("group")).collect():  # TAILS + FREQUENT rows
        if r["stat"] == 1:
            voc.tail[r["doc_id"]] = r["n"]
        else:
            group[r["doc_id"]] = r["group"]
    voc.settle(group)
    weights = Network.start(voc).flat
    shards = max(1, round(voc.tokens / SHARD))
    parts = min(shards, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    learned = encoded.filter("stat = 0 and learn").select(F.pmod("key", F.lit(shards)).alias("shard"), "key", "ids")
    dealt = cut(learned.repartition(parts, "shard").sortWithinPartitions("shard", "key"))
    for k in range(len(RATES)):
        weights = train(dealt, parts, voc, weights, k)
    return counts.filter("kind = 0"), voc, weights, encoded


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    counts, voc, weights, encoded = fit(docs)
    sc = docs.sparkSession.sparkContext
    held = sc.broadcast((weights, np.log(voc.tail + 1), math.log(voc.tokens + TAILS), voc.end, voc.order, np.log(np.maximum(voc.frequent, 1))))

    def run(batches):
        flat, tail, all_, end, order, frequent = held.value
        net = Network(flat)
        frequent = np.append(frequent, np.zeros(TAILS)) - all_ + math.log(UNIGRAM)

        def scores(ids: list[bytes]) -> np.ndarray:
            y = order[np.frombuffer(b"".join(ids), "<u2")]
            at = np.concatenate([[0], np.cumsum([len(x) // 2 for x in ids])])
            before = _inputs(y, at, end)
            logp = np.empty(len(y))
            state = np.zeros((HIDDEN, LANES), np.float32)
            kept, places, size = [], [], 0

            def flush():
                place = np.concatenate(places)
                logp[place] = net.output(np.concatenate(kept, axis=1).T, y[place])[0]

            for place, fresh in windows(at, STEPS, LANES):
                states = net.states(before[place], fresh, np.ascontiguousarray(state[:, : place.shape[1]]))
                state = states[-1]
                every, place = states.transpose(1, 0, 2).reshape(HIDDEN, -1), place.ravel()
                on = np.flatnonzero(place >= 0)
                kept.append(every if len(on) == len(place) else np.take(every, on, axis=1))
                places.append(place if len(on) == len(place) else place[on])
                size += len(on)
                if size > 1 << 15:
                    flush()
                    kept, places, size = [], [], 0
            if size:
                flush()
            rare = np.flatnonzero(y >= FREQUENT)
            logp[rare] -= tail[y[rare] - FREQUENT]
            logp += math.log(1 - UNIGRAM)
            uni = frequent[y]  # of a tail word its count comes as a factor of both
            high = np.maximum(logp, uni)
            mixed = np.log1p(np.exp(np.minimum(logp, uni) - high))
            mixed += high
            return np.add.reduceat(mixed, at[:-1]) / math.log(10)

        def out(rows: list[pa.RecordBatch]):
            t = pa.Table.from_batches(rows).combine_chunks()
            s = scores(t.column("ids").to_pylist())
            return t.drop_columns(["ids"]).append_column("net", pa.array(s)).to_batches()

        rows, size = [], 0
        for b in batches:
            at = 0
            n = np.cumsum(b.column("n_tokens").to_numpy())
            while at < len(b):
                to = max(at + 1, int(np.searchsorted(n, (n[at - 1] if at else 0) + BUFFER - size, "right")))
                rows.append(b.slice(at, to - at))
                size += int(n[to - 1] - (n[at - 1] if at else 0))
                at = to
                if size >= BUFFER or at < len(b):
                    yield from out(rows)
                    rows, size = [], 0
        if rows:
            yield from out(rows)

    plain = encoded.filter("stat = 0").select("doc_id", "n_tokens", "known", "base", "model", "words", "times", "ids")
    scored = plain.mapInArrow(run, "doc_id long, n_tokens long, known long, base double, model double, words array<long>, times array<long>, net double")
    own = cut(scored).withColumn("_row", F.monotonically_increasing_id())
    rare = own.filter("size(words) > 0").select("_row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("_row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    more = rare.join(counts.select("word", "n"), "word").groupBy("_row").agg(F.sum("times").alias("k"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("l1"), F.sum(F.col("times") * F.log10("n")).alias("l0"))
    out = own.select("doc_id", "n_tokens", "known", "base", "model", "net", "_row").join(more, "_row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    base = math.log10(voc.tokens + voc.distinct + 1)
    return out.select(
        "doc_id", held_out().alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(voc.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("l1") - F.col("n_tokens") * F.lit(base)).alias("base_score"), (F.col("net") + F.col("model") + zero("l0")).alias("score"),
    )
