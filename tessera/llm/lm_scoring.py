"""Operator 6, LM scoring: stupid backoff from relational count tables.

The tables count all n-grams of all documents, split by hash among shards.  A
block of documents sends each shard its different n-grams with their counts in
the block; the shard adds them up (this is the count table's join with the
exploded n-grams, each key once a block) and sends the sums back; the block
scores every word and adds up by document.  n-grams longer than two are asked
for only where both their parts occur `least` times, since no others can.

For word w after the words h, with counts over all documents:
  S(w | h) = c(h w) / c(h)           if c(h w) >= least
           = backoff * S(w | h[1:])  else
  S(w)     = c(w) / N
A document's start has shorter histories.  Words are `[^\\x20\\x09-\\x0D]+`.

Null and empty texts have no words, log_score 0 and a null mean_log_score.  A null
doc_id is a document like any other; repeated rows count twice.  Extra columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Exchange, blocked, deltas, expand, narrow, shard_runs, sized, squeeze, sums, table_bytes
from .textkit import U, WORD, WORD_BASE, chunks, mix, windows

#: n-gram hashes go without their lowest bits, to be shorter messages.
KEY_SHIFT = U(12)


def block_grams(table: pa.Table, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(for n = 1 .. order the hash of the n words that end at each word, words of each row, place of each word in its document)."""
    names, n_words = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for c in chunks(table["text"]):
        names.append(c.word_hashes())
        n_words.append(np.diff(c.doc_words))
    name, count = np.concatenate(names), np.concatenate(n_words)
    begin = np.cumsum(count) - count
    place = np.arange(len(name)) - np.repeat(begin, count)
    grams = []
    for n in range(1, order + 1):
        g = np.zeros(len(name), np.uint64)
        if len(name) >= n:
            g[n - 1 :] = mix(windows(name, n, WORD_BASE) ^ U(n))
        grams.append(g >> KEY_SHIFT)
    return grams, count, place


def lm_scoring(docs: DataFrame, order: int = 3, least: int = 2, backoff: float = 0.4, block_bytes: int = 2 << 20, shard_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_words, log_score (natural) and mean_log_score for each row of docs (doc_id, text)."""
    blocks, _ = blocked(docs, [], sized(docs, block_bytes))
    exchange = Exchange(blocks, max(64, math.ceil(table_bytes(docs) / sized(docs, shard_bytes))), table_bytes(docs))
    shards = exchange.shards
    total = int(docs.select(F.sum(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)))).first()[0] or 0)

    def ask(keys):
        different, count = np.unique(keys, return_counts=True)
        return [(s, squeeze(deltas(different[i:j]), narrow(count[i:j]))) for s, i, j in shard_runs(different << KEY_SHIFT, shards)]

    def short(grams, place):
        return np.concatenate([grams[0], grams[1][place >= 1]] if order > 1 else [grams[0]])

    def add(messages):
        opened = [(b, *expand(m)) for b, m in messages]
        keys = [sums(k) for _, k, _ in opened]
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        summed = np.bincount(inverse, weights=np.concatenate([c for *_, c in opened]).astype(np.float64)).astype(np.int64)[inverse]
        at = 0
        for (block, *_), k in zip(opened, keys, strict=True):
            yield block, squeeze(narrow(summed[at : at + len(k)]))
            at += len(k)

    def told(answers):
        """The sums for the different keys that were asked for, in their order."""
        return np.concatenate([expand(answers[s])[0].astype(np.int64) for s in sorted(answers)] or [np.empty(0, np.int64)])

    def each(sums_, keys):
        """Of all keys; their places are worked out again, as they would be long to keep."""
        return sums_[np.unique(keys, return_inverse=True)[1]] if len(keys) else sums_

    def ask_short(table, answers, state):
        grams, _, place = block_grams(table, 2)
        yield from ask(short(grams, place))

    def longer(n):
        """Round for the n-grams whose two parts of n - 1 words occur often enough."""

        def go(table, answers, state):
            grams, _, place = block_grams(table, n)
            known = counts(state, answers, grams, place, n - 1)
            asked = wanted(place, known, n)
            yield from ask(grams[n - 1][asked])
            before = expand(state) if state else []
            yield None, squeeze(*before, narrow(told(answers)))

        return go

    def wanted(place, known, n):
        """Words whose n-gram is asked for: both its parts occur often enough."""
        often = known[n - 2] >= least
        return np.flatnonzero((place >= n - 1) & often & np.concatenate([[False], often[:-1]]))

    def counts(state, answers, grams, place, n):
        """Counts of the 1- .. n-grams that end at each word, 0 where not asked for.  The state holds the answers of earlier rounds."""
        got = [x.astype(np.int64) for x in (expand(state) if state else [])] + [told(answers)]
        c = each(got[0], short(grams, place))
        known = [c[: len(place)], np.zeros(len(place), np.int64)]
        known[1][place >= 1] = c[len(place) :]
        for k in range(3, n + 1):
            asked = wanted(place, known, k)
            known.append(np.zeros(len(place), np.int64))
            known[-1][asked] = each(got[k - 2], grams[k - 1][asked])
        return known[: max(n, 1)]

    def score(table, answers, state):
        grams, n_words, place = block_grams(table, order)
        c = counts(state, answers, grams, place, order)
        with np.errstate(divide="ignore"):
            s = np.log(c[0].astype(np.float64) / max(total, 1))
            for n in range(2, order + 1):
                history = np.concatenate([[1], c[n - 2][:-1]])
                here = place >= n - 1
                good = here & (c[n - 1] >= least)
                s = np.where(good, np.log(np.maximum(c[n - 1], 1) / np.maximum(history, 1)), np.where(here, math.log(backoff) + s, s))
        ends = np.cumsum(n_words)
        out = np.array([math.fsum(s[e - n : e]) for e, n in zip(ends, n_words, strict=True)])
        mean = [x / n if n else None for x, n in zip(out, n_words.tolist(), strict=True)]
        return pa.table({"doc_id": table["doc_id"], "n_words": pa.array(n_words, pa.int64()), "log_score": pa.array(out, pa.float64()), "mean_log_score": pa.array(mean, pa.float64())})

    exchange.round(ask_short, add)
    for n in range(3, order + 1):
        exchange.round(longer(n), add)
    return exchange.finish(score, "doc_id long, n_words long, log_score double, mean_log_score double")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_scoring(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.withColumns({c: F.round(c, 6) for c in ("log_score", "mean_log_score")})


#: The same scores in DuckDB.
OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), t AS (
  SELECT r, i, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS v, CASE WHEN i > 2 THEN ws[i - 2] END AS u
  FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)
), c AS (
  SELECT r, i, count(*) OVER (PARTITION BY w) AS c1, count(*) OVER () AS n,
         CASE WHEN i > 1 THEN count(*) OVER (PARTITION BY v, w, i > 1) END AS c2,
         CASE WHEN i > 2 THEN count(*) OVER (PARTITION BY u, v, w, i > 2) END AS c3 FROM t
), h AS (
  SELECT *, lag(c1) OVER o AS h1, lag(c2) OVER o AS h2 FROM c WINDOW o AS (PARTITION BY r ORDER BY i)
), s1 AS (
  SELECT *, ln(c1::DOUBLE / n) AS s1 FROM h
), s2 AS (
  SELECT *, CASE WHEN i = 1 THEN s1 WHEN c2 >= 2 THEN ln(c2::DOUBLE / h1) ELSE ln(0.4::DOUBLE) + s1 END AS s2 FROM s1
), s3 AS (
  SELECT r, CASE WHEN i <= 2 THEN s2 WHEN c3 >= 2 THEN ln(c3::DOUBLE / h2) ELSE ln(0.4::DOUBLE) + s2 END AS s3 FROM s2
), a AS (
  SELECT r, fsum(s3) AS s, count(*) AS n FROM s3 GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, round(coalesce(s, 0), 6) AS log_score, round(s / n, 6) AS mean_log_score
FROM d LEFT JOIN a USING (r)
"""
