"""Operator 1, quality rules: a short-circuit cascade ordered by rejection per cost.

Each rule needs some features of a text and says which texts it rejects.  A
bounded sample gives every rule's cost (seconds a text for the features that no
earlier rule has made) and selectivity; rules run in order of rejections per
second.  In each batch a rule sees only the texts that all earlier rules passed.
The counts that are part of the result are made for all texts, once, and cost a
rule nothing more: rules that need no others come first, and a feature beyond them
is made for the texts that are left.  The verdict does not depend on the order,
which only the time taken does.

The sample is a random share of the rows of about `sample_bytes` of text; tasks
measure it where it lies, and the driver gets the times and how many rows each
combination of rules rejects.

Null and empty texts have no words and fail `min_words`.  Any column may be null.
Extra input columns are ignored; repeated rows give repeated results.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import table_bytes
from .textkit import BYTE_BASE, BYTE_VALUE, U, WORD_BASE, Chunk, chunks, mix, prefix_sums, span_hash, windows

SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[list(b"#*$%&|<>")] = 1
UPPER = np.zeros(256, np.int64)
UPPER[65:91] = 1
LETTER = UPPER.copy()
LETTER[97:123] = 1
LETTER[0xC3] = 1  # Latin letters with accents
MARKS = np.zeros(256, np.int64)
MARKS[list(b"!?")] = 1
DIGITS = np.zeros(256, np.int64)
DIGITS[48:58] = 1

Features = dict[str, np.ndarray]


def per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of flags over each document."""
    s = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return s[bounds[1:]] - s[bounds[:-1]]


def words_feature(c: Chunk) -> Features:
    return {"n_words": np.diff(c.doc_words).astype(np.int64)}


def chars_feature(c: Chunk) -> Features:
    s = np.concatenate([[0], np.cumsum((c.data & 0xC0) != 0x80, dtype=np.int64)])
    spaces = (c.data == 32) | ((c.data >= 9) & (c.data <= 13))
    return {"word_chars": s[c.offsets[1:]] - s[c.offsets[:-1]] - per_doc(spaces, c.offsets)}


def bytes_feature(name: str, table: np.ndarray) -> Callable[[Chunk], Features]:
    return lambda c: {name: per_doc(table[c.data], c.offsets)}


def lines_feature(c: Chunk) -> Features:
    """Lines with a word; those equal to an earlier line of the document."""
    ends = np.unique(np.concatenate([np.flatnonzero(c.data == 10), c.offsets[1:]]))
    starts = np.concatenate([[0], ends[:-1] + (ends[:-1] < len(c.data)) * (c.data[np.minimum(ends[:-1], len(c.data) - 1)] == 10)]) if len(ends) else ends
    # a document that ends without a newline is followed at once by the next one; one that ends with it has an empty last line
    full = np.searchsorted(c.starts, ends) > np.searchsorted(c.starts, starts)
    starts, ends = starts[full], ends[full]
    doc = np.searchsorted(c.offsets, starts, "right") - 1
    h = span_hash(prefix_sums(BYTE_VALUE[c.data], BYTE_BASE), starts, ends, BYTE_BASE)
    _, first = np.unique(mix(h ^ mix(doc.astype(np.uint64) + U(1))), return_index=True)
    lines = np.bincount(doc, minlength=c.n)
    return {"n_lines": lines, "n_dup_lines": lines - np.bincount(doc[first], minlength=c.n)}


def repeats_feature(c: Chunk, size: int = 3) -> Features:
    """Words in windows of `size` words that the document has twice or more."""
    n, doc = len(c.starts), c.word_doc
    covered = np.zeros(n + 1, np.int64)
    if n >= size:
        own = doc[size - 1 :] == doc[: n - size + 1]
        at = np.flatnonzero(own)
        key = mix(windows(c.word_hashes(), size, WORD_BASE)[at] ^ mix(doc[at].astype(np.uint64) + U(1)))
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        at = at[count[inverse] > 1]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + size, -1)
    return {"n_repeat_words": per_doc(np.cumsum(covered[:n]) > 0, c.doc_words)}


#: Feature group: what makes it.  Each gives a few named counts for each document.
MAKERS: dict[str, Callable[[Chunk], Features]] = {
    "words": words_feature,
    "chars": chars_feature,
    "symbols": bytes_feature("n_symbols", SYMBOLS),
    "upper": lambda c: bytes_feature("n_upper", UPPER)(c) | bytes_feature("n_letters", LETTER)(c),
    "marks": bytes_feature("n_marks", MARKS),
    "lines": lines_feature,
    "repeats": repeats_feature,
}


@dataclass(frozen=True)
class Rule:
    """rejects: of the features that `needs` names, which texts go."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[[Features], np.ndarray]


BASE_RULES = (
    Rule("min_words", ("words",), lambda f: f["n_words"] < 50),
    Rule("repeated_windows", ("words", "repeats"), lambda f: 100 * f["n_repeat_words"] > 50 * f["n_words"]),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", ("words", "symbols"), lambda f: 10 * f["n_symbols"] > f["n_words"]),
    Rule("word_length", ("words", "chars"), lambda f: (f["word_chars"] < 2 * f["n_words"]) | (f["word_chars"] > 20 * f["n_words"])),
    Rule("upper_case", ("upper",), lambda f: 10 * f["n_upper"] > 4 * f["n_letters"]),
    Rule("marks", ("words", "marks"), lambda f: 4 * f["n_marks"] > f["n_words"]),
    Rule("duplicate_lines", ("lines",), lambda f: 10 * f["n_dup_lines"] > 6 * f["n_lines"]),
)


def sub_chunk(c: Chunk, docs: np.ndarray) -> Chunk:
    """Only the given documents."""
    lengths = np.diff(c.offsets)[docs]
    keep = np.zeros(len(c.data) + 1, np.int8)
    np.add.at(keep, c.offsets[docs], 1)
    np.add.at(keep, c.offsets[docs + 1], -1)
    return Chunk(c.data[np.cumsum(keep[:-1]) > 0], np.concatenate([[0], np.cumsum(lengths)]), c.first)


def run_cascade(c: Chunk, rules: tuple[Rule, ...], known: Features | None = None, always: tuple[str, ...] = ()) -> np.ndarray:
    """The place of the first rule that rejects each text, -1: none.  known: features of the groups in `always`, which are not made again."""
    verdict, alive = np.full(c.n, -1), np.arange(c.n)
    part, own, have = c, dict(known or {}), set(always)
    narrowed = False
    for k, rule in enumerate(rules):
        if narrowed and not have.issuperset(rule.needs):
            part, narrowed = sub_chunk(c, alive), False
        for name in rule.needs:
            if name not in have:
                own |= MAKERS[name](part)
                have.add(name)
        bad = rule.rejects(own)
        if bad.any():
            verdict[alive[bad]] = k
            left = np.flatnonzero(~bad)
            alive, own, narrowed = alive[left], {n: v[left] for n, v in own.items()}, True
            if not len(left):
                break
    return verdict


def measured(docs: DataFrame, rules: tuple[Rule, ...], sample_bytes: int, seed: int = 11) -> tuple[dict[str, float], np.ndarray, np.ndarray]:
    """(seconds a text of each feature group, rejections (rules, combinations), texts of each combination) on a random sample of the rows.

    At most 2 ** len(rules) combinations come to the driver, whatever the sample.
    """
    names = sorted({n for r in rules for n in r.needs})
    share = min(1.0, sample_bytes / max(1, table_bytes(docs)))
    rows = docs.select(F.col("text").cast("string").alias("text"))
    rows = rows.sample(fraction=share, seed=seed) if share < 1 else rows

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        took, seen = dict.fromkeys(names, 0.0), np.zeros(1 << len(rules), np.int64)
        for b in batches:
            for c in chunks(b.column(0)):
                own: Features = {}
                for name in names:
                    began = time.perf_counter()
                    own |= MAKERS[name](c)
                    took[name] += time.perf_counter() - began
                seen += np.bincount(sum(r.rejects(own).astype(np.int64) << k for k, r in enumerate(rules)), minlength=len(seen))
        at = np.flatnonzero(seen)
        kinds = [*(f"rules {x}" for x in at.tolist()), *(f"time {n}" for n in names)]
        yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array([*seen[at].astype(float), *(took[n] for n in names)], pa.float64())], names=["kind", "amount"])

    found = dict(rows.mapInArrow(measure, "kind string, amount double").groupBy("kind").agg(F.sum("amount")).collect())
    which = sorted(int(k.split()[1]) for k in found if k.startswith("rules "))
    count = np.array([found[f"rules {x}"] for x in which])
    rejected = np.array([[x >> k & 1 for x in which] for k in range(len(rules))], bool).reshape(len(rules), len(which))
    return {n: found.get(f"time {n}", 0.0) / max(1.0, count.sum()) for n in names}, rejected, count


def by_rate(rules: tuple[Rule, ...], cost: dict[str, float], rejected: np.ndarray, count: np.ndarray, always: tuple[str, ...] = ()) -> tuple[Rule, ...]:
    """The rules by rejections per second, greedily: what an earlier rule made, or `always`, is free."""
    out: list[Rule] = []
    left, have, alive = list(range(len(rules))), set(always), np.ones(rejected.shape[1], bool)
    while left:
        rest = max(1.0, float(count[alive].sum()))
        rate = {k: float(count[alive & rejected[k]].sum()) / rest / (1e-9 + sum(cost.get(n, 0.0) for n in rules[k].needs if n not in have)) for k in left}
        best = max(left, key=lambda k: (rate[k], have.issuperset(rules[k].needs), -k))
        left.remove(best)
        out.append(rules[best])
        have |= set(rules[best].needs)
        alive &= ~rejected[best]
    return tuple(out)


def ordered(docs: DataFrame, rules: tuple[Rule, ...], always: tuple[str, ...] = (), sample_bytes: int = 4 << 20) -> tuple[Rule, ...]:
    """The rules in the order of the cascade; `always`: feature groups that are there anyway."""
    cost, rejected, count = measured(docs, rules, sample_bytes)
    return by_rate(rules, cost, rejected, count, always) if len(count) else rules


#: Feature groups that the result shows, which all texts need.
SHOWN = ("words", "chars", "symbols", "lines", "repeats")


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, the base counts, base_failed and kept for each row of docs (doc_id, text)."""
    base = {r.name for r in BASE_RULES}
    rest = ordered(docs, tuple(r for r in rules if r.name not in base), SHOWN, sample_bytes)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, text = b.column(0), b.column(1)
            for c in chunks(text):
                f: Features = {}
                for name in SHOWN:
                    f |= MAKERS[name](c)
                failed = np.zeros(c.n, bool)
                for r in BASE_RULES:
                    failed |= r.rejects(f)
                kept = ~failed
                if rest and kept.any():
                    alive = np.flatnonzero(kept)
                    verdict = run_cascade(sub_chunk(c, alive), rest, {n: v[alive] for n, v in f.items()}, SHOWN)
                    kept[alive[verdict >= 0]] = False
                cols = [pa.array(f[n], pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                yield pa.RecordBatch.from_arrays([ids.slice(c.first, c.n), *cols, pa.array(failed), pa.array(kept)], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(apply, schema)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: The same counts and verdicts in DuckDB.
OP1_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), grams AS (
  SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w
), g AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS c FROM grams
), rep AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM g WHERE c > 1) GROUP BY r
), l AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), f AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(l.n_dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
         length(t) - length(regexp_replace(t, '[A-Za-zÀ-ÿ]', '', 'g')) AS n_letters,
         length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS n_marks,
         coalesce(l.n_lines, 0) AS n_lines
  FROM w LEFT JOIN l USING (r) LEFT JOIN rep USING (r)
), v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 10 * n_upper > 4 * n_letters OR 4 * n_marks > n_words OR 10 * n_dup_lines > 6 * n_lines) AS kept
FROM v
"""
