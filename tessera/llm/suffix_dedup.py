"""Operator 5, suffix-array dedup: merged Burrows-Wheeler transforms find strings of earlier documents.

A byte goes if it lies in a string of `size` bytes that also starts in a document
with a smaller doc_id.  All occurrences of such a string must meet in one shard:

1. In each window of `size` bytes the least hash of its `gram`-byte substrings is
   the window's anchor, so equal windows have equal anchors.  Blocks ask the
   shards which anchors other documents have too.
2. For those, blocks send the text that the anchor's windows cover, each different
   text once with its least doc_id.  A shard makes the Burrows-Wheeler transform of
   the texts of each half of the corpus (blocks of even and of odd number) and merges
   the two: the interleave of their suffixes starts unsorted and is refined `step`
   bytes at a time by counting over the transforms' symbols, until it is in order by
   the first `size` bytes.  The refinement that parts two neighbours tells their
   common prefix; intervals with one of `size` bytes are the repeated ones, and each
   gives its least doc_id back.  Suffixes are not sorted or compared in the merge.
3. The block removes the bytes that the answers cover.

Texts are whole; null texts are empty; texts under `size` bytes keep everything.
A row with a null doc_id has no order: it loses nothing and costs others nothing.
Rows with equal doc_id never cost each other bytes.  Extra columns pass
through; one named like a result comes out with `_in` after its name.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .blocks import Exchange, blocked, deltas, expand, shard_runs, sized, squeeze, sums, table_bytes
from .carry import REST, packed, unpacked
from .textkit import BYTE_BASE, BYTE_VALUE, U, chunks, mix, prefix_sums, span_hash, windows

NEVER = np.iinfo(np.int64).max
#: Low hash bits that the first round leaves out: keys alike by chance only ask for a text in vain.
KEY_SHIFT = U(16)
#: Tags by which a shard tells anchors apart; two that share one are merged together.
TAGS = 1 << 24
#: Bytes of text of which a shard makes transforms at a time.
PART_BYTES = 1 << 19

#: The results' names.
OWN = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]


def doc_ids(table: pa.Table) -> np.ndarray:
    return table["doc_id"].fill_null(NEVER).to_numpy().astype(np.int64)


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` hashes the place of its least one.

    The lowest bits give way to the place, so that the minimum tells it; among equal
    hashes any one is as good, since only its value must be the same in equal windows.
    """
    bits = max(1, (width - 1).bit_length())
    low = U((1 << bits) - 1)
    place = np.arange(len(h), dtype=np.uint64)
    m, have = (h & ~low) | (place & low), 1
    while 2 * have <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < width:
        m = np.minimum(m[: len(m) - (width - have)], m[width - have :])
    start = place[: len(m)]
    return (start + ((m - start) & low)).astype(np.int64)


def dealt(anchors: np.ndarray) -> np.ndarray:
    """Anchors are least hashes and so low ones; this spreads them evenly over the shards."""
    return mix(anchors + U(0x2545F4914F6CDD1D))


def block_anchors(table: pa.Table, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """(place of each anchor among the block's bytes, its hash, its first window, its number of windows, its row), in order."""
    base, out = 0, [(np.empty(0, np.int64), np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)]
    for c in chunks(table["text"]):
        if len(c.data) >= size:
            h = windows(BYTE_VALUE[c.data], gram, BYTE_BASE)
            least = window_minima(h, size - gram + 1)
            doc = np.repeat(np.arange(c.n, dtype=np.int32), np.diff(c.offsets))
            own = np.flatnonzero(doc[: len(least)] == doc[size - 1 : size - 1 + len(least)])
            at, doc = least[own], doc[own]
            change = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])) if len(own) else np.empty(0, np.int64)
            n = np.diff(np.append(change, len(own)))
            out.append((at[change] + base, dealt(h[at[change]]), own[change] + base, n, doc[change].astype(np.int64) + c.first))
        base += len(c.data)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def block_bytes_of(table: pa.Table) -> np.ndarray:
    return np.concatenate([c.data for c in chunks(table["text"])] or [np.empty(0, np.uint8)])


def span_hashes(table: pa.Table, starts: np.ndarray, *spans: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Hashes of spans (starts, ends) of the block's bytes, chunk by chunk.  starts: ascending, and in the chunk of each span."""
    base, out = 0, [[np.empty(0, np.uint64)] for _ in spans]
    for c in chunks(table["text"]):
        i, j = np.searchsorted(starts, [base, base + len(c.data)])
        if j > i:
            s = prefix_sums(BYTE_VALUE[c.data], BYTE_BASE)
            for k, (a, b) in enumerate(spans):
                out[k].append(span_hash(s, a[i:j] - base, b[i:j] - base, BYTE_BASE))
        base += len(c.data)
    return [np.concatenate(x) for x in out]


def dense(keys: np.ndarray) -> np.ndarray:
    """Ranks of the keys, equal for equal ones."""
    order = np.argsort(keys)
    k = keys[order]
    out = np.empty(len(keys), np.uint32)
    out[order] = np.cumsum(np.concatenate([[False], k[1:] != k[:-1]]), dtype=np.uint32) if len(k) else 0
    return out


class Rotations:
    """Texts as cyclic strings: ranks order all rotations by their first bytes."""

    def __init__(self, data: np.ndarray, lengths: np.ndarray):
        self.data = data
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int32)
        self.begin, self.length = np.repeat(begin, lengths), np.repeat(lengths.astype(np.int32), lengths)
        self.at = np.arange(len(data), dtype=np.int32) - self.begin

    def later(self, n: int) -> np.ndarray:
        """The rotation that starts n bytes after each one; |n| is less than any length."""
        at = self.at + np.int32(n)
        return self.begin + np.where(at >= self.length, at - self.length, np.where(at < 0, at + self.length, at))

    def first_rank(self, n: int) -> np.ndarray:
        """Ranks by the first n bytes."""
        key, have = np.zeros(len(self.data), np.uint64), min(8, n)
        for i in range(have):
            key = key << U(8) | self.data[self.later(i)]
        return self.longer(dense(key), have, n)

    def longer(self, rank: np.ndarray, have: int, n: int) -> np.ndarray:
        """Ranks by n bytes from ranks by `have`, doubling."""
        while have < n:
            step = min(have, n - have)
            rank = dense(rank.astype(np.uint64) << U(32) | rank[self.later(step)].astype(np.uint64))
            have += step
        return rank


def transform(data: np.ndarray, lengths: np.ndarray, size: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of one corpus shard's rotations in order by `size` bytes, its transform: the `step` bytes before each)."""
    r = Rotations(data, lengths)
    places = np.argsort(r.first_rank(size), kind="stable")
    before = np.zeros(len(data), np.uint16)
    for i in range(step, 0, -1):
        before = before << np.uint16(8) | data[r.later(-i)]
    return places, before[places]


def interleave(first: np.ndarray, second: np.ndarray, size: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether each rotation of the merged order is the second's, its common prefix with the one before, down to `step` bytes) from two transforms.

    The interleave says only whose rotation comes next, and starts unsorted.  Each
    refinement deals its places to the symbols of the transforms, which keeps their order
    within a symbol: a counting sort of 16-bit symbols.  That orders the rotations `step`
    bytes further on by those bytes as well; no rotation is compared or sorted again.  A
    border between two places, once it is there, stays where it is, and the refinement
    that brings it tells the length of the common prefix; `size` means that or more.
    """
    n = len(first) + len(second)
    z = np.zeros(n, bool)
    z[len(first) :] = True
    block, common = np.zeros(n, np.uint32), np.full(n, size, np.uint16)
    common[:1] = 0
    symbol = np.empty(n, np.uint16)
    for k in range(size // step):
        symbol[~z], symbol[z] = first, second
        order = np.argsort(symbol, kind="stable")
        c, old, z = symbol[order], block[order], z[order]
        border = np.empty(n, bool)
        border[:1] = False
        border[1:] = (c[1:] != c[:-1]) | (old[1:] != old[:-1])
        common[border & (common == size)] = k * step
        block = np.cumsum(border, dtype=np.uint32)
    return z, common


def merged_intervals(data: np.ndarray, lengths: np.ndarray, half: np.ndarray, size: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(rotations in merged order, their common prefixes): the two halves' transforms, merged.  half: for each text 0 or 1."""
    side = np.repeat(half, lengths)
    places, parts = [], []
    for s in (0, 1):
        own = np.flatnonzero(side == s)
        at, symbols = transform(data[own], lengths[half == s], size, step) if len(own) else (own, np.empty(0, np.uint16))
        places.append(own[at])
        parts.append(symbols)
    z, common = interleave(*parts, size, step)
    rotations = np.empty(len(data), np.int64)
    rotations[~z], rotations[z] = places
    return rotations, common


def least_docs(data: np.ndarray, lengths: np.ndarray, docs: np.ndarray, half: np.ndarray, size: int, step: int) -> np.ndarray:
    """For each window of each text, one after another, the least document with the same `size` bytes."""
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    at = gather(begin, lengths - size + 1)
    if not len(data):
        return at
    rotations, common = merged_intervals(data, lengths, half, size, step)
    # rotations that run over a text's end are no windows
    own = np.full(len(data), NEVER)
    own[at] = np.repeat(docs, lengths - size + 1)
    # a repeated interval: places with a common prefix of `size` bytes
    edges = np.flatnonzero(common < size)
    least = np.repeat(np.minimum.reduceat(own[rotations], edges), np.diff(np.append(edges, len(common))))
    own[rotations] = least
    return own[at]


def runs_of(values: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of equal values in stretches of n[i] values: (runs of each stretch, lengths, values)."""
    ends = np.cumsum(n)
    edge = np.ones(len(values), bool)
    edge[1:] = values[1:] != values[:-1]
    edge[ends[:-1]] = True
    at = np.flatnonzero(edge)
    return np.bincount(np.searchsorted(ends, at, "right"), minlength=len(n)), np.diff(np.append(at, len(values))), values[at]


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[i] .. starts[i] + lengths[i], one run after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - np.concatenate([[0], ends[:-1]]), lengths) + np.arange(ends[-1] if len(ends) else 0)


def suffix_dedup(docs: DataFrame, size: int = 50, gram: int = 20, step: int = 2, block_bytes: int = 1 << 20, shard_bytes: int = 2 << 20, kept: bool = False, columns: list[str] | None = None) -> DataFrame:
    """For each row of docs (doc_id, text, columns): n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept: what remains, without parts of characters."""
    if size % step or step not in (1, 2):
        raise ValueError("step must be 1 or 2 bytes and divide size")
    extra = columns or []
    blocks, _ = blocked(docs.select("doc_id", "text", packed(extra)), [REST], sized(docs, block_bytes))
    shards = max(64, math.ceil(table_bytes(docs) / sized(docs, shard_bytes)))
    exchange = Exchange(blocks, shards, table_bytes(docs))

    def keys_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(hashes >> KEY_SHIFT, return_inverse=True)

    def ask_anchors(table, answers, state):
        at, hashes, low, n, row = block_anchors(table, size, gram)
        keys, inverse = keys_of(hashes)
        first = np.full(len(keys), -1)
        first[inverse] = row
        several = np.zeros(len(keys), bool)
        several[inverse[row != first[inverse]]] = True
        for shard, i, j in shard_runs(keys << KEY_SHIFT, shards):
            yield shard, squeeze(deltas(keys[i:j]), np.packbits(several[i:j]))
        yield None, squeeze(deltas(at), (at - low).astype(np.uint8 if size < 256 else np.uint32), n.astype(np.uint8 if size < 256 else np.uint32), deltas(row))

    def answer_anchors(messages):
        opened = [(b, *expand(m)) for b, m in messages]
        keys = [sums(k) for _, k, _ in opened]
        everything = np.concatenate(keys)
        several = np.concatenate([np.unpackbits(x, count=len(k)) for k, (_, _, x) in zip(keys, opened, strict=True)]).astype(bool)
        _, inverse, count = np.unique(everything, return_inverse=True, return_counts=True)
        many = count > 1
        many[inverse[several]] = True
        found, at = many[inverse], 0
        for (block, *_), k in zip(opened, keys, strict=True):
            yield block, squeeze(np.packbits(found[at : at + len(k)]))
            at += len(k)

    def ask_texts(table, answers, state):
        at, below, n, row = expand(state)
        at, row = sums(at).astype(np.int64), sums(row).astype(np.int64)
        low, n = at - below, n.astype(np.int64)
        data = block_bytes_of(table)
        hashes, text = span_hashes(table, at, (at, at + gram), (low, low + n + size - 1))
        hashes = dealt(hashes)
        keys, inverse = keys_of(hashes)
        found = np.zeros(len(keys), bool)
        for shard, i, j in shard_runs(keys << KEY_SHIFT, shards):
            if shard in answers:
                found[i:j] = np.unpackbits(expand(answers[shard])[0], count=j - i)
        doc = doc_ids(table)[row] if len(row) else row
        take = np.flatnonzero(found[inverse] & (doc != NEVER)) if len(inverse) else np.empty(0, np.int64)
        low, n, doc, hashes, text = low[take], n[take], doc[take], hashes[take], text[take]
        # one text for all its occurrences here: by shard, then by its hash
        text = mix(text ^ n.astype(np.uint64))
        key = (hashes & ~U(0xFFFFFFFF)) | (text >> U(32))
        order = np.lexsort((text, key))
        k1, k2 = key[order], text[order]
        new = np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]) if len(order) else np.empty(0, bool)
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        edges = np.flatnonzero(new)
        chosen = order[edges]
        least = np.minimum.reduceat(doc[order], edges) if len(edges) else doc
        for shard, i, j in shard_runs(k1[edges], shards):
            rows = chosen[i:j]
            tag = (hashes[rows] >> U(8)).astype(np.uint32) & np.uint32(TAGS - 1)
            yield shard, squeeze(n[rows].astype(np.uint8 if size < 256 else np.uint32), tag, data[gather(low[rows], n[rows] + size - 1)], least[i:j])
        yield None, squeeze(deltas(low), which.astype(np.uint32), deltas(row[take]))

    def answer_texts(messages):
        opened = [(b, *expand(m)) for b, m in messages]
        n, tag, docs_ = (np.concatenate([x[k] for x in opened]) for k in (1, 2, 4))
        n, data = n.astype(np.int64), np.concatenate([x[3] for x in opened])
        source = np.repeat(np.arange(len(opened)), [len(x[1]) for x in opened])
        lengths = n + size - 1
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        done: list[tuple[np.ndarray, ...]] = []
        # equal windows have one anchor and so one tag: a few tags at a time bound the memory
        parts = 1 + len(data) // PART_BYTES
        for p in range(parts):
            own = np.flatnonzero(tag % np.uint32(parts) == p) if parts > 1 else np.arange(len(n))
            s = prefix_sums(BYTE_VALUE[data[gather(begin[own], lengths[own])]], BYTE_BASE)
            at = np.concatenate([[0], np.cumsum(lengths[own])[:-1]])
            text = mix(span_hash(s, at, at + lengths[own], BYTE_BASE) ^ tag[own].astype(np.uint64))
            _, first, inverse = np.unique(text, return_index=True, return_inverse=True)
            least = np.full(len(first), NEVER)
            np.minimum.at(least, inverse, docs_[own])
            first = own[first]
            # an anchor with one text only has nothing to merge: its windows' least document is the text's
            _, group, texts = np.unique(tag[first], return_inverse=True, return_counts=True)
            several = np.flatnonzero(texts[group] > 1)
            count, length, value = np.ones(len(first), np.int64), n[first], least
            if len(several):
                rows = first[several]
                found = least_docs(data[gather(begin[rows], lengths[rows])], lengths[rows], least[several], (source[rows] & 1).astype(np.int8), size, step)
                c, m, v = runs_of(found, n[rows])
                single = np.flatnonzero(texts[group] == 1)
                count[several] = c
                owner = np.concatenate([single, np.repeat(several, c)])
                order = np.argsort(owner, kind="stable")
                length, value = np.concatenate([length[single], m])[order], np.concatenate([value[single], v])[order]
            start = np.concatenate([[0], np.cumsum(count)[:-1]])
            take = gather(start[inverse], count[inverse])
            done.append((np.repeat(own, count[inverse]), length[take], value[take]))
        owner, length, value = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(owner, kind="stable")
        length, value, per_text = length[order], value[order], np.bincount(owner, minlength=len(n))
        stop = np.cumsum(per_text)
        i = 0
        for k, (block, m, *_) in enumerate(opened):
            j = i + len(m)
            a, b = (stop[i - 1] if i else 0), (stop[j - 1] if j else 0)
            yield block, squeeze(per_text[i:j].astype(np.uint8 if size < 256 else np.uint32), length[a:b].astype(np.uint8 if size < 256 else np.uint32), value[a:b])
            i = j

    def remove(table, answers, state):
        low, which, row = expand(state)
        low, row = sums(low).astype(np.int64), sums(row).astype(np.int64)
        parts = [expand(answers[s]) for s in sorted(answers)]
        data = block_bytes_of(table)
        cover = np.zeros(len(data) + 1, np.int32)
        if parts and len(low):
            count = np.concatenate([p[0] for p in parts]).astype(np.int64)
            length, value = np.concatenate([p[1] for p in parts]).astype(np.int64), np.concatenate([p[2] for p in parts])
            first = np.concatenate([[0], np.cumsum(count)[:-1]])
            runs = gather(first[which], count[which])
            own = np.repeat(np.arange(len(which)), count[which])
            # where each run starts: the lengths of the text's runs before it
            upto = np.concatenate([[0], np.cumsum(length)])
            start = low[own] + upto[runs] - upto[first[which]][own]
            hit = value[runs] < doc_ids(table)[row][own]
            np.add.at(cover, start[hit], 1)
            np.add.at(cover, start[hit] + length[runs][hit] + size - 1, -1)
        gone = np.cumsum(cover[:-1]) > 0
        ends = np.cumsum([len(x) for x in document_bytes(table)], dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        begins = gone & ~np.concatenate([[False], gone[:-1]])
        begins[starts[starts < len(gone)]] = gone[starts[starts < len(gone)]]
        g, b = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, begins))
        rest = [data[i:j][~gone[i:j]].tobytes() if g[j] > g[i] else data[i:j].tobytes() for i, j in zip(starts, ends, strict=True)]
        out = {"doc_id": table["doc_id"], REST: table[REST], "n_bytes": pa.array(ends - starts, pa.int64()), "n_removed": pa.array(g[ends] - g[starts], pa.int64()), "n_spans": pa.array(b[ends] - b[starts], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in rest], pa.string())}
        if kept:
            out["kept"] = pa.array([x.decode("utf-8", "ignore") for x in rest], pa.string())
        return pa.table(out)

    exchange.round(ask_anchors, answer_anchors)
    exchange.round(ask_texts, answer_texts)
    schema = ", ".join(["doc_id long", f"{REST} {dict(blocks.dtypes)[REST]}", "n_bytes long, n_removed long, n_spans long, kept_sha256 string", *["kept string"] * kept])
    out = exchange.finish(remove, schema)
    return out.select("doc_id", *unpacked(extra, OWN), *[c for c in OWN[1:] if c in out.columns])


def document_bytes(table: pa.Table) -> list[np.ndarray]:
    return [c.data[c.offsets[i] : c.offsets[i + 1]] for c in chunks(table["text"]) for i in range(c.n)]


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: The same in DuckDB, over the hexadecimal form of the bytes: for small tables.
OP5_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), b AS (
  SELECT r, doc_id, h, unnest(range(len(h) // 2)) AS i FROM d
), w AS (
  SELECT r, doc_id, i, substr(h, 2 * i + 1, 2) AS byte, CASE WHEN 2 * i + 100 <= len(h) THEN substr(h, 2 * i + 1, 100) END AS win FROM b
), m AS (
  SELECT r, doc_id, i, byte, win IS NOT NULL AND min(doc_id) OVER (PARTITION BY win) < doc_id AS hit FROM w
), c AS (
  SELECT r, i, byte, count_if(hit) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) > 0 AS gone FROM m
), s AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), FALSE) AS begins FROM c
), a AS (
  SELECT r, count(*) AS n_bytes, count_if(gone) AS n_removed, count_if(begins) AS n_spans,
         coalesce(string_agg(byte, '' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM s GROUP BY r
)
SELECT doc_id, coalesce(n_bytes, 0)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN a USING (r)
"""
