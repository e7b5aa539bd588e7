"""Quality rules by weak supervision: rules vote good, bad or abstain; expectation-maximisation over the vote patterns of all
documents estimates each rule's accuracy; a document is kept by its posterior probability of being good.

Vote patterns are counted in Spark (at most 3^rules of them, whatever the number of documents), so the fit sees every
document. Null and empty texts have no words: all their measures are 0, ``base_failed`` is true and they aren't kept. An
empty table gives an empty result. Repeated rows give repeated results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import by_slice, cut, slim
from ._text import Words, mix

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC2, 0xF5)]] = True  # ASCII letters, and other code points by their first byte
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_letters long, n_stops long, n_distinct long"
#: name, condition for "bad", condition for "good"; anything else abstains. Most rules only know what bad looks like.
RULES = (
    ("length", "n_words < 20", "false"),
    ("symbols", "n_symbols * 10 > n_words", "false"),
    ("dense_symbols", "n_symbols * 4 > n_words", "false"),
    ("dup_lines", "n_dup_lines * 10 > 3 * n_lines", "false"),
    ("repeats", "n_repeat_words * 10 > 3 * n_words", "false"),
    ("word_length", "word_chars < 2.5 * n_words OR word_chars > 12 * n_words", "word_chars BETWEEN 3.5 * n_words AND 9 * n_words"),
    ("letters", "n_letters < 0.75 * word_chars", "n_letters >= 0.9 * word_chars"),
    ("sentences", "n_stops * 300 + 50 < n_words", "false"),
    ("variety", "n_distinct < 0.4 * pow(n_words, 0.85)", "false"),
)
ROUNDS = 50
#: What a rule is taken for before any vote is seen, as P(vote | class) over (abstain, bad, good), and how much that counts
#: against all documents' votes together: only enough to say which class is the good one.
START = np.array([[[0.55, 0.40, 0.05], [0.59, 0.01, 0.40]]])
ANCHOR = 0.01


def measures(docs: DataFrame) -> DataFrame:
    def kernel(part):
        w = Words(part.column("text"), lower=False)
        h = w.hashes()
        cover = np.zeros(len(h), bool)
        m = len(h) - 2
        if m > 0:
            same = w.doc[:m] == w.doc[2:]
            key = mix(mix(h[:m]) + mix(h[1:-1] + np.uint64(11)) * np.uint64(3) + mix(h[2:] + np.uint64(13)) * np.uint64(5)) + w.doc[:m].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            at = np.flatnonzero(same)
            o = at[np.argsort(key[at], kind="stable")]
            eq = key[o[1:]] == key[o[:-1]]
            again = np.zeros(len(o), bool)
            again[1:] |= eq
            again[:-1] |= eq
            hit = o[again]
            for j in range(3):
                cover[hit + j] = True
        per_word = lambda mask: np.bincount(w.doc[mask], minlength=w.n)
        keyed = mix(h + w.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        firsts = np.zeros(len(h), bool)
        firsts[np.unique(keyed, return_index=True)[1]] = True
        lead = (w.raw & 0xC0) != 0x80
        dup, lines = [], []
        for t in part.column("text").to_pylist():
            seen: set[str] = set()
            d = n = 0
            for line in t.split("\n"):
                if line.strip(" \t\n\x0b\x0c\r"):
                    n += 1
                    d += line in seen
                    seen.add(line)
            dup.append(d)
            lines.append(n)
        return {
            "doc_id": part.column("doc_id"), "n_words": w.count.astype(np.int64), "word_chars": w.per_doc(lead & ~w.ws), "n_symbols": w.per_doc(_SYMBOL[w.raw]), "n_dup_lines": pa.array(dup, pa.int64()), "n_repeat_words": per_word(cover), "n_lines": pa.array(lines, pa.int64()),
            "n_letters": w.per_doc(_LETTER[w.raw]), "n_stops": w.per_doc(_STOP[w.raw]), "n_distinct": per_word(firsts),
        }

    return by_slice(slim(docs), kernel, f"doc_id long, {MEASURES}")


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[float, np.ndarray]:
    """Prior of good, and P(vote | class) as [rule, class (bad, good), vote (abstain, bad, good)], from votes 0, 1, 2 and their counts.

    ``START`` is where the rounds begin and a Dirichlet prior of weight ``ANCHOR`` for every rule: it keeps class 1 the one that
    "good" votes for, and keeps probabilities off 0.
    """
    n, m = patterns.shape if patterns.size else (0, len(RULES))
    like = np.repeat(START, m, axis=0)
    prior = 0.9
    if n == 0:
        return prior, like
    weight = counts / counts.sum()
    for _ in range(rounds):
        good = posterior(patterns, prior, like)
        prior = float(np.clip((weight * good).sum(), 0.01, 0.99))
        for r in range(m):
            for c, q in ((0, 1 - good), (1, good)):
                s = np.bincount(patterns[:, r], weight * q, minlength=3) + ANCHOR * START[0, c]
                like[r, c] = s / s.sum()
    return prior, like


def posterior(patterns: np.ndarray, prior: float, like: np.ndarray) -> np.ndarray:
    logit = np.full(len(patterns), np.log(prior / (1 - prior)))
    for r in range(like.shape[0]):
        logit += np.log(like[r, 1, patterns[:, r]] / like[r, 0, patterns[:, r]])
    return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def assess(docs: DataFrame) -> DataFrame:
    """One row per document: the base measures, ``base_failed``, ``quality`` (posterior of good) and ``kept``."""
    m = measures(docs)
    code = sum((F.when(F.expr(bad), 1).when(F.expr(good), 2).otherwise(0) * 3**i for i, (_, bad, good) in enumerate(RULES)), F.lit(0))
    voted = cut(m.withColumn("_votes", code.cast("int")))  # ten numbers a document: texts are read once
    rows = voted.groupBy("_votes").count().collect()  # 3^9 rows at most
    codes = np.array([r["_votes"] for r in rows], np.int64)
    patterns = np.stack([codes // 3**i % 3 for i in range(len(RULES))], axis=1) if len(codes) else np.zeros((0, len(RULES)), np.int64)
    prior, like = fit(patterns, np.array([r["count"] for r in rows], float))
    logit = F.lit(float(np.log(prior / (1 - prior))))
    for i in range(len(RULES)):
        ratio = [float(x) for x in np.log(like[i, 1] / like[i, 0])]
        vote = F.floor(F.col("_votes") / 3**i) % 3
        logit = logit + F.when(vote == 1, ratio[1]).when(vote == 2, ratio[2]).otherwise(ratio[0])
    out = voted.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")).withColumn("quality", 1 / (1 + F.exp(-logit)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
