"""Operator 7, substring dedup by recompression of the word sequence.

Each round shortens the documents' sequences of symbols twice: a run of equal
symbols becomes one, then pairs of a left symbol and a right one do (a bit of the
name says which of the two a symbol is).  The names are global: blocks of documents
send the shards the different runs and pairs that they have, a shard keeps the
table of those that it is given, and answers with a name for each that occurs twice
or more in all documents and with none for the others.  So equal stretches have the
same symbols inside, in whatever blocks they lie.

Where a symbol begins and ends depends on its neighbours only; each keeps the
stretch of words that decide it.  A window with a symbol inside that nothing else
has cannot repeat: after each round such windows go, and with them the symbols that
no other window holds, so that the next round works on what is left.

What is left after the rounds shares all its high-level symbols with something, and
is verified by 96 bits of two independent hashes of the windows' words.

A word goes if a window over it starts anywhere else too.  Whole texts are read;
null texts have no words, texts shorter than a window keep all.  A null doc_id is
a document like any other; repeated rows repeat each other.  Extra columns pass;
one named like a result comes out with `_in` after its name.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .blocks import Exchange, blocked, deltas, expand, narrow, shard_of, shard_runs, sized, squeeze, sums, table_bytes
from .carry import REST, packed, unpacked
from .textkit import BYTE_BASE, BYTE_VALUE, U, WORD_BASE, chunks, mix, prefix_sums, span_hash, windows

#: Low hash bits of runs and pairs left out in messages: two alike by chance have one name and are told apart in the end.
KEY_SHIFT = U(16)

#: The results' names.
OWN = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
#: Room for the words of a block in keys of (stretch, word).
WIDE = np.int64(1) << np.int64(36)


class Symbols:
    """A sequence of names for some stretches of words; left, right: the words [left, right) that decide a symbol; at: its stretch.

    begin, end: the stretches' words.  A symbol that lies by a stretch's end and would
    depend on what is beyond has a left before its begin, or a right after its end.
    """

    def __init__(self, name, left, right, at, begin, end):
        self.name, self.left, self.right, self.at, self.begin, self.end = name, left, right, at, begin, end

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether the next symbol is of the same stretch: for each symbol to the left, to the right."""
        same = self.at[1:] == self.at[:-1]
        return np.concatenate([[False], same]), np.concatenate([same, [False]])

    def wider(self, to_left: np.ndarray, to_right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """left and right where the symbol also depends on its neighbour; past a stretch's end nothing decides it."""
        has_left, has_right = self.neighbours()
        prev = np.where(has_left, np.concatenate([self.left[:1], self.left[:-1]]), self.begin[self.at] - 1)
        following = np.where(has_right, np.concatenate([self.right[1:], self.right[-1:]]), self.end[self.at] + 1)
        return np.where(to_left, np.minimum(self.left, prev), self.left), np.where(to_right, np.maximum(self.right, following), self.right)

    def runs(self, salt: int) -> tuple["Symbols", np.ndarray]:
        """(each maximal run of one symbol as one symbol, whether it is one of several); a symbol alone keeps its name."""
        n = len(self.name)
        if not n:
            return self, np.empty(0, bool)
        has_left, _ = self.neighbours()
        first = np.flatnonzero(~has_left | np.concatenate([[True], self.name[1:] != self.name[:-1]]))
        last = np.append(first[1:], n) - 1
        length = (last - first + 1).astype(np.uint64)
        every = np.ones(n, bool)
        left, right = self.wider(every, every)
        name = np.where(length > 1, mix(self.name[first] ^ mix(length + U(salt))), self.name[first])
        return Symbols(name, left[first], right[last], self.at[first], self.begin, self.end), length > 1

    def pairs(self, salt: int) -> tuple["Symbols", np.ndarray, np.ndarray]:
        """(a left symbol and a right one after it as one symbol, whether it is a pair, the first one's place here)."""
        n = len(self.name)
        if not n:
            return self, np.empty(0, bool), np.empty(0, np.int64)
        is_left = (mix(self.name ^ U(salt)) >> U(63)) == 0
        _, has_right = self.neighbours()
        first = np.zeros(n, bool)
        first[:-1] = is_left[:-1] & ~is_left[1:] & has_right[:-1]
        second = np.concatenate([[False], first[:-1]])
        left, right = self.wider(~is_left, is_left)
        keep = np.flatnonzero(~second)
        mate = np.minimum(keep + 1, n - 1)
        merged = first[keep]
        name = np.where(merged, mix(self.name[keep] * U(0x9E3779B97F4A7C15) + mix(self.name[mate] + U(salt))), self.name[keep])
        return Symbols(name, np.where(merged, np.minimum(left[keep], left[mate]), left[keep]), np.where(merged, np.maximum(right[keep], right[mate]), right[keep]), self.at[keep], self.begin, self.end), merged, keep

    def shorter(self, k: int) -> tuple["Symbols", np.ndarray]:
        """(the sequence after round k's runs and pairs, which of its symbols want a global name: the others have theirs)."""
        joined, run = self.runs(2 * k + 1)
        out, pair, place = joined.pairs(2 * k + 2)
        return out, pair | (run[place] if len(place) else run)


def whole(names: np.ndarray, bounds: np.ndarray, size: int) -> Symbols:
    """The words of the documents that have a window, which are the first stretches.  names: word hashes; bounds: where the documents begin."""
    n = np.diff(bounds)
    long = np.flatnonzero(n >= size)
    begin, end = bounds[:-1][long], bounds[1:][long]
    at = gather(begin, end - begin)
    return Symbols(names[at], at, at + 1, np.repeat(np.arange(len(long)), end - begin), begin, end)


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[i] .. starts[i] + lengths[i], one run after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - np.concatenate([[0], ends[:-1]]), lengths) + np.arange(ends[-1] if len(ends) else 0)


def without(s: Symbols, lone: np.ndarray, size: int) -> Symbols:
    """The stretches of windows that hold none of the lone symbols, with the symbols that lie inside them."""
    n = s.end - s.begin - size + 1
    offset = np.concatenate([[0], np.cumsum(n)])
    at, shift = s.at[lone], (offset[:-1] - s.begin)[s.at[lone]]
    low, high = np.maximum(s.right[lone] - size, s.begin[at]) + shift, np.minimum(s.left[lone], s.end[at] - size) + shift
    hit = low <= high
    gone = np.cumsum(np.bincount(low[hit], minlength=offset[-1] + 1) - np.bincount(high[hit] + 1, minlength=offset[-1] + 1))[:-1] > 0
    of = np.repeat(np.arange(len(n)), n)
    alive = np.flatnonzero(~gone)
    first = np.ones(len(alive), bool)
    first[1:] = (np.diff(alive) > 1) | (np.diff(of[alive]) > 0)
    edges = np.flatnonzero(first)
    old = of[alive[edges]]
    begin = alive[edges] - offset[:-1][old] + s.begin[old]
    end = begin + np.diff(np.append(edges, len(alive))) - 1 + size
    low = np.searchsorted(s.at * WIDE + s.left + 1, old * WIDE + begin + 1)
    high = np.searchsorted(s.at * WIDE + s.right, old * WIDE + end, "right")
    count = np.maximum(high - low, 0)
    take = gather(low, count)
    return Symbols(s.name[take], s.left[take], s.right[take], np.repeat(np.arange(len(edges)), count), begin, end)


def kept_state(s: Symbols, wants: np.ndarray) -> bytes:
    """The sequence as a block's message to itself."""
    counts = np.bincount(s.at, minlength=len(s.begin))
    back = s.left - s.begin[s.at] + 1
    return squeeze(deltas(s.begin), narrow(s.end - s.begin), narrow(counts), s.name, narrow(back), narrow(s.right - s.left), np.packbits(wants))


def from_state(state: bytes) -> tuple[Symbols, np.ndarray]:
    begin, length, counts, name, back, span, wants = expand(state)
    begin, counts = sums(begin).astype(np.int64), counts.astype(np.int64)
    at = np.repeat(np.arange(len(begin)), counts)
    left = begin[at] + back.astype(np.int64) - 1
    return Symbols(name, left, left + span.astype(np.int64), at, begin, begin + length.astype(np.int64)), np.unpackbits(wants, count=len(name)).astype(bool)


def ask_names(s: Symbols, wants: np.ndarray, shards: int) -> list[tuple[int, bytes]]:
    """Messages of the block's different runs and pairs, and whether the block has them twice."""
    different, count = np.unique(s.name[wants] >> KEY_SHIFT, return_counts=True)
    return [(shard, squeeze(deltas(different[i:j]), np.packbits(count[i:j] > 1))) for shard, i, j in shard_runs(different << KEY_SHIFT, shards)]


def name_table(messages):
    """The shard's table: for each run or pair of a message its number, from 1, or 0 where it occurs once in all."""
    opened = [(b, *expand(m)) for b, m in messages]
    keys = [sums(k) for _, k, _ in opened]
    several = np.concatenate([np.unpackbits(x, count=len(k)) for k, (_, _, x) in zip(keys, opened, strict=True)]).astype(bool)
    _, inverse, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    many = count > 1
    many[inverse[several]] = True
    number, at = np.where(many, np.cumsum(many), 0)[inverse], 0
    for (block, *_), k in zip(opened, keys, strict=True):
        yield block, squeeze(narrow(number[at : at + len(k)]))
        at += len(k)


def named(s: Symbols, wants: np.ndarray, answers: dict[int, bytes], shards: int) -> np.ndarray:
    """Puts the global names in; returns which symbols are alone in all documents."""
    lone = np.zeros(len(s.name), bool)
    if wants.any():
        different, inverse = np.unique(s.name[wants] >> KEY_SHIFT, return_inverse=True)
        number = np.concatenate([expand(answers[x])[0].astype(np.uint64) for x in sorted(answers)])
        shard = shard_of(different << KEY_SHIFT, shards).astype(np.uint64)
        s.name = s.name.copy()
        s.name[wants] = mix(((shard + U(1)) << U(36)) | number)[inverse]
        lone[wants] = (number == 0)[inverse]
    return lone


def block_words(table: pa.Table, second: bool = False):
    """(word hashes, where the rows' words begin and their number); second: hashes of the other kind too."""
    names, others, counts = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], [np.zeros(1, np.int64)]
    for c in chunks(table["text"]):
        names.append(c.word_hashes())
        if second:
            others.append(span_hash(prefix_sums(OTHER_VALUE[c.data], BYTE_BASE), c.starts, c.ends, BYTE_BASE))
        counts.append(np.diff(c.doc_words))
    return np.concatenate(names), np.cumsum(np.concatenate(counts)), np.concatenate(others)


#: A second value for each byte, for hashes that are independent of the first ones.
OTHER_VALUE = mix(BYTE_VALUE ^ U(0x5851F42D4C957F2D))


def ordered(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(an order by both hashes, where it brings a new pair, the number of each one's pair)."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(order) else np.empty(0, bool)
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return order, new, which


def ask_twice(first: np.ndarray, second: np.ndarray, shards: int):
    """Messages of the different windows, by both their hashes, and whether the block has them twice; and each one's place among them."""
    order, new, which = ordered(first, second)
    edges = np.flatnonzero(new)
    a, b = first[order][edges], second[order][edges]
    many = np.diff(np.append(edges, len(order))) > 1
    return [(shard, squeeze(deltas(a[i:j]), b[i:j], np.packbits(many[i:j]))) for shard, i, j in shard_runs(a, shards)], which


def answer_twice(messages):
    """Which of a message's windows occur twice in all."""
    opened = [(b, *expand(m)) for b, m in messages]
    sizes = [len(x) for _, _, x, _ in opened]
    several = np.concatenate([np.unpackbits(x, count=k) for k, (*_, x) in zip(sizes, opened, strict=True)]).astype(bool)
    _, _, which = ordered(np.concatenate([sums(k) for _, k, _, _ in opened]), np.concatenate([x for _, _, x, _ in opened]))
    many = np.bincount(which) > 1
    many[which[several]] = True
    found, at = many[which], 0
    for (block, *_), k in zip(opened, sizes, strict=True):
        yield block, squeeze(np.array([k], np.int64), np.packbits(found[at : at + k]))
        at += k


def told(answers) -> np.ndarray:
    """The answers to all windows in their order."""
    parts = [expand(answers[s]) for s in sorted(answers)]
    return np.concatenate([np.unpackbits(x, count=int(n[0])) for n, x in parts]).astype(bool) if parts else np.empty(0, bool)


def recompression_dedup(docs: DataFrame, size: int = 35, rounds: int = 3, block_bytes: int = 3 << 19, shard_bytes: int = 4 << 20, kept: bool = False, columns: list[str] | None = None) -> DataFrame:
    """For each row of docs (doc_id, text, columns): n_words, n_removed, kept_sha256 and, if asked for, kept: the words that remain."""
    extra = columns or []
    blocks, _ = blocked(docs.select("doc_id", "text", packed(extra)), [REST], sized(docs, block_bytes))
    exchange = Exchange(blocks, max(64, math.ceil(table_bytes(docs) / sized(docs, shard_bytes))), table_bytes(docs))
    shards = exchange.shards

    def start(table) -> Symbols:
        names, bounds, _ = block_words(table)
        return whole(names, bounds, size)

    def left_after(k: int, table, answers, state) -> Symbols:
        """The sequence after round k, from the names that the shards have given."""
        # the first round's sequence is as long as the texts: made again rather than kept
        s, wants = start(table).shorter(1) if state is None else from_state(state)
        return without(s, named(s, wants, answers, shards), size)

    def ask_round(k: int):
        def go(table, answers, state):
            s = start(table) if k == 1 else left_after(k - 1, table, answers, state)
            s, wants = s.shorter(k)
            yield from ask_names(s, wants, shards)
            if k > 1:
                yield None, kept_state(s, wants)

        return go

    def ask_windows(table, answers, state):
        s = left_after(rounds, table, answers, state) if rounds else start(table)
        first, n = s.begin, s.end - s.begin - size + 1
        names, _, others = block_words(table, True)
        starts = gather(first, n)
        a, b = windows(names, size, WORD_BASE), windows(others, size, WORD_BASE)
        messages, which = ask_twice(a[starts], (b[starts] >> U(32)).astype(np.uint32), shards)
        yield from messages
        yield None, squeeze(deltas(first), narrow(n), which.astype(np.uint32))

    def remove(table, answers, state):
        first, n, which = expand(state)
        starts = gather(sums(first).astype(np.int64), n.astype(np.int64))
        starts = starts[told(answers)[which]] if len(which) else starts
        names, bounds, _ = block_words(table)
        cover = np.bincount(starts, minlength=len(names) + size + 1)[: len(names) + 1] - np.bincount(starts + size, minlength=len(names) + size + 1)[: len(names) + 1]
        gone = np.cumsum(cover)[: len(names)] > 0
        out, gone_counts = [], []
        for text, a, b in zip(table["text"].to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            words = (text or b"").split()
            mask = gone[a:b]
            k = int(mask.sum())
            out.append(b" ".join([w for w, g in zip(words, mask.tolist(), strict=True) if not g] if k else words))
            gone_counts.append(k)
        own = {"doc_id": table["doc_id"], REST: table[REST], "n_words": pa.array(np.diff(bounds), pa.int64()), "n_removed": pa.array(gone_counts, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in out], pa.string())}
        if kept:
            own["kept"] = pa.array([x.decode("utf-8", "replace") for x in out], pa.string())
        return pa.table(own)

    for k in range(1, rounds + 1):
        exchange.round(ask_round(k), name_table, with_texts=k < 3)
    exchange.round(ask_windows, answer_twice)
    schema = ", ".join(["doc_id long", f"{REST} {dict(blocks.dtypes)[REST]}", "n_words long, n_removed long, kept_sha256 string", *["kept string"] * kept])
    out = exchange.finish(remove, schema)
    return out.select("doc_id", *unpacked(extra, OWN), *[c for c in OWN[1:] if c in out.columns])


def op7_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: The same in DuckDB by a hash of each window's words: for small tables.
OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), w AS (
  SELECT r, i, ws[i] AS word, CASE WHEN i + 34 <= len(ws) THEN md5(array_to_string(ws[i:i + 34], ' ')) END AS win
  FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)
), m AS (
  SELECT r, i, word, win IS NOT NULL AND count(*) OVER (PARTITION BY win) > 1 AS hit FROM w
), c AS (
  SELECT r, i, word, count_if(hit) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) > 0 AS gone FROM m
), a AS (
  SELECT r, count_if(gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM c GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN a USING (r)
"""
