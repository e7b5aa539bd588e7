"""One query per corpus operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprints, ngram_join, packing, pii, quality, rnnlm, secretscan, substrings, toxicity
from ._spark import documents

#: Only for runs whose surrogates may be undone by anyone; a real one is set as ``spark.graphloom.pii.key``.
SHOWN_KEY = "not a secret"


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats(documents(spark, sf_dir))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.find_secrets(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.assess(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rnnlm.score(documents(spark, sf_dir))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(documents(spark, sf_dir))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_next(documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(documents(spark, sf_dir))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.protect(documents(spark, sf_dir), spark.conf.get("spark.graphloom.pii.key", SHOWN_KEY))


def corpus_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2_secrets counts by fixed patterns."""
    return op2_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def corpus_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op4_lm counts, and its score by counts alone."""
    return op4_lm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def corpus_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edited texts that op6_fingerprints compares with."""
    return op6_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def corpus_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules of op7_quality measure."""
    return op7_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


_ALL = (op1_substrings, op2_secrets, op3_toxicity, op4_lm, op5_ngram_join, op6_fingerprints, op7_quality, op8_bpe, op9_packing, op10_pii, corpus_secrets, corpus_unigrams, corpus_edits, corpus_measures)
QUERIES = {f.__name__: f for f in _ALL}
# In DuckDB: ASCII lower case, words, and a text's CRC-32 (by its definition, bit by bit).
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, CAST(3988292384 AS BIGINT) * (x & 1)))), CAST(4294967295 AS BIGINT))"
_ANY_CASE = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name) for name in ("password", "passwd", "secret", "token", "api_?key"))
#: The rest is beyond SQL (fitted models, decoding, packing, keyed surrogates): tests hold it against brute force.
ORACLE_SQL: dict[str, str] = {
    "corpus_secrets": rf"""SELECT doc_id, CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '({_ANY_CASE})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 12)) AS BIGINT) n_assign,
CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18)) AS BIGINT) n_access, CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 16)) AS BIGINT) n_hex FROM documents""",
    "corpus_unigrams": f"""WITH d AS (SELECT doc_id, {_CRC} % 7 = 2 AS held_out, list_append({_WORDS.format(_LOWER)}, '') w FROM documents),
t AS (SELECT doc_id, held_out, unnest(w) x FROM d), c AS (SELECT x, count(*) n FROM t WHERE NOT held_out GROUP BY 1), s AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) n, count(*) v FROM c)
SELECT t.doc_id, t.held_out, count(*) n_tokens, count(c.n) n_known, any_value(s.n) train_tokens, round(sum(log10((coalesce(c.n, 0) + 1) / (s.n + s.v + 1))), 4) base_score FROM t LEFT JOIN c USING (x), s GROUP BY 1, 2""",
    "corpus_edits": """WITH d AS (SELECT doc_id, coalesce(text, '') t FROM documents), n AS (SELECT doc_id, t, length(t) k, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) f FROM d)
SELECT doc_id, k n_chars, sha256(left(t, k - k // 4) || left(f, k // 4)) edited_sha256 FROM n""",
    "corpus_measures": rf"""WITH d AS (SELECT doc_id, coalesce(text, '') t FROM documents), w AS (SELECT doc_id, t, {_WORDS.format('t')} w FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) i, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) g FROM w),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) n FROM g), r AS (SELECT doc_id, count(DISTINCT i + k) n FROM h, (SELECT unnest([0, 1, 2]) k) WHERE n >= 2 GROUP BY 1),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l FROM d),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) n_repeat_words FROM w JOIN l USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m""",
    "op5_ngram_join": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END s FROM w),
rows AS (SELECT doc_id, unnest(s) x FROM sets),
met AS (SELECT a.doc_id a, b.doc_id b, count(*) n FROM rows a JOIN rows b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b WHERE 100 * n >= 90 * (len(p.s) + len(q.s) - n)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM sets UNION SELECT reach.a, sym.b FROM reach JOIN sym ON reach.b = sym.a)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) n_shingles, min(reach.b) component_id FROM sets JOIN reach ON reach.a = sets.doc_id GROUP BY 1, 2""",
}
