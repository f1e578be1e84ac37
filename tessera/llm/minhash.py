"""Operator 4, MinHash near-dedup with bottom-k sketches.

A document's set is its different shingles of `words` words (lower-cased A-Z), or
its whole word sequence if it has fewer.  One hash gives each shingle a value and
the `k` least values are the document's sketch.

1. Documents with equal sets are one class; from here on only its least doc_id counts.
2. Inverted lists of the retained values generate overlaps.  Two sets with Jaccard
   0.8 share 0.8 k of the union's k least values on average; fewer than half is
   out of reach (a chance of 2e-8 at k = 64, by candidates and estimates; sets that lie whole in their
   sketches must share `threshold` of them).  So a document need only look at its
   rarest values, all but that many less one: common passages, which many
   documents hold, drop out unless most of a document is made of them.
3. Documents that share such a value are linked to the list's least one; the
   components of these weak links are the groups to look into.  A group's sets
   meet in one task, groups above `group_docs` in one task for each pair of their
   parts.  There a walk from document to document counts overlaps by the group's
   inverted lists, estimates similarity on union sketches, and verifies on the
   full sets; documents already reached are not compared again.
4. The components of the verified links are the result.

Null and empty texts have empty sets and are linked with nothing.  A row without
doc_id is linked with nothing, has a null component and is kept.  Repeated rows
have equal results.  Extra columns pass through; one named like a result comes out
with `_in` after its name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .carry import packed, unpacked
from .graph import connected
from .session import cut
from .textkit import BYTE_BASE, BYTE_VALUE, U, WORD_BASE, chunks, mix, prefix_sums, release, span_hash

EMPTY = np.empty(0, np.uint64)


def shingle_sets(column, words: int) -> Iterator[np.ndarray]:
    """The sorted set of shingle values of each text."""
    for c in chunks(column):
        s = prefix_sums(BYTE_VALUE[c.lowered()], BYTE_BASE)
        s = prefix_sums(span_hash(s, c.starts, c.ends, BYTE_BASE), WORD_BASE)
        n, at = len(c.starts), c.doc_words
        i = np.arange(max(0, n - words + 1))
        h = span_hash(s, i, i + words, WORD_BASE)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= words:
                yield np.unique(h[a : b - words + 1])
            elif b > a:
                yield mix(span_hash(s, np.array([a]), np.array([b]), WORD_BASE) ^ U(b - a))
            else:
                yield EMPTY


def sketches(docs: DataFrame, words: int, k: int) -> DataFrame:
    """doc_id, n (set size), f1 and f2 (a fingerprint of the set), sketch for each row of docs (doc_id, text, ...), other columns first."""
    columns = [c for c in docs.columns if c != "text"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, f1, f2, flat = [], [], [], []
            for x in shingle_sets(b.column(len(columns)), words):
                n.append(len(x))
                f1.append(int(x.sum(dtype=np.uint64)))
                f2.append(int(np.bitwise_xor.reduce(mix(x + U(0x632BE59BD9B4E019)))) if len(x) else 0)
                flat.append(x[:k].view(np.int64).copy())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in flat])]), pa.int32()), pa.array(np.concatenate(flat) if flat else np.empty(0, np.int64)))
            prints = [pa.array(np.array(f, np.uint64).view(np.int64)) for f in (f1, f2)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], pa.array(n, pa.int64()), *prints, lists], names=[*columns, "n", "f1", "f2", "sketch"])
        release()

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "n long, f1 long, f2 long, sketch array<long>"])
    return docs.select(*columns, F.col("text").cast("string")).mapInArrow(make, schema)


def candidate_groups(classes: DataFrame, k: int, threshold: float) -> DataFrame:
    """(node, component): weak components of classes (rep, n, sketch) by shared rare values."""
    values = classes.select("rep", "n", F.size("sketch").alias("m"), F.explode("sketch").alias("value"))
    often = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    shared = values.join(often, "value")
    least = F.when(F.col("n") <= threshold * k, F.ceil(F.col("n") * F.lit(threshold) - 1e-9)).otherwise(F.ceil(F.least("n", F.lit(k)) / 2))
    rows = shared.groupBy("rep").agg(F.first("m").alias("m"), F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "value"))).alias("v"))
    # values that no other class has are rarest and come first; they link with nothing
    take = (F.col("m") - least + 1) - (F.col("m") - F.size("v"))
    near = rows.select("rep", F.explode(F.slice("v", F.lit(1), F.greatest(take, F.lit(0)).cast("int"))).alias("x")).select("rep", F.col("x.value").alias("value"))
    near = cut(near)
    hubs = near.groupBy("value").agg(F.min("rep").alias("hub"), F.count("*").alias("df")).where("df > 1")
    return connected(near.join(hubs, "value").select(F.col("rep").alias("a"), F.col("hub").alias("b")))


def linked(ids: list[int], sets: list[np.ndarray], k: int, percent: int, margin: float = 0.3) -> list[tuple[int, int]]:
    """Links that join what is connected: 100 * intersection >= percent * union on full sets.

    With the margin an estimate passes at half of the sketch, as candidates do.
    """
    n = len(sets)
    size = np.array([len(x) for x in sets])
    sketch = [x[:k] for x in sets]
    values = np.concatenate(sketch) if n else EMPTY
    owner = np.repeat(np.arange(n), [len(x) for x in sketch])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    threshold = percent / 100
    need = np.where(size <= threshold * k, np.ceil(size * threshold - 1e-9), np.ceil(np.minimum(size, k) / 2))
    # sketches as rows, padded by values that no shingle has, and all postings of the full sets
    rows = np.full((n, k), np.iinfo(np.uint64).max, np.uint64)
    for i, x in enumerate(sketch):
        rows[i, : len(x)] = x
    flat = np.concatenate(sets) if n else EMPTY
    order = np.argsort(flat, kind="stable")
    flat, holder = flat[order], np.repeat(np.arange(n, dtype=np.int32), size)[order]
    fresh, out = np.ones(n, bool), []
    for seed in range(n):
        if not fresh[seed]:
            continue
        fresh[seed] = False
        queue = [seed]
        while queue:
            x = queue.pop()
            low, high = np.searchsorted(values, sketch[x], "left"), np.searchsorted(values, sketch[x], "right")
            lists = [owner[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True) if b - a > 1]
            if not lists:
                continue
            overlap = np.bincount(np.concatenate(lists), minlength=n)
            short, long = np.minimum(size, size[x]), np.maximum(size, size[x])
            near = np.flatnonzero(fresh & (overlap > 0) & (overlap >= np.minimum(need, need[x])) & (100 * short >= percent * long))
            if len(near):
                near = near[estimates(rows[x], rows[near], k) >= threshold - margin]
            if not len(near):
                continue
            low, high = np.searchsorted(flat, sets[x], "left"), np.searchsorted(flat, sets[x], "right")
            both = np.bincount(holder[runs(low, high - low)], minlength=n)[near]
            found = near[100 * both >= percent * (size[x] + size[near] - both)]
            fresh[found] = False
            out += [(ids[x], ids[y]) for y in found.tolist()]
            queue += found.tolist()
    return out


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[i] .. starts[i] + lengths[i], one run after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def estimates(x: np.ndarray, others: np.ndarray, k: int) -> np.ndarray:
    """For each row of others the share of its union with x's k least values that both hold."""
    none = np.iinfo(np.uint64).max
    merged = np.sort(np.concatenate([np.broadcast_to(x, others.shape), others], axis=1), axis=1)
    same = (merged[:, 1:] == merged[:, :-1]) & (merged[:, 1:] != none)
    real = merged != none
    rank = np.cumsum(real & ~np.concatenate([np.zeros((len(merged), 1), bool), same], axis=1), axis=1)
    return (same & (rank[:, 1:] <= k)).sum(axis=1) / np.maximum(np.minimum(rank[:, -1], k), 1)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, k: int = 64, group_docs: int = 4_000, columns: list[str] | None = None) -> DataFrame:
    """doc_id, columns, n_shingles, component_id and kept for each row of docs (doc_id, text, columns)."""
    extra = columns or []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), packed(extra), F.col("text").cast("string").alias("text"))
    seen = cut(sketches(docs, words, k))
    own = seen.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = cut(own.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep")))
    whole = own.join(classes.withColumnRenamed("rep", "doc_id"), ["n", "f1", "f2", "doc_id"], "left_semi").select(F.col("doc_id").alias("rep"), "n", "sketch")
    groups = cut(candidate_groups(whole, k, percent / 100))
    # a group's documents are dealt to parts; each pair of parts is a task's work
    sizes = groups.groupBy("component").agg(F.count("*").alias("docs")).withColumn("parts", F.ceil(F.col("docs") / group_docs).cast("int"))
    placed = groups.join(sizes, "component").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [x.tobytes() for x in shingle_sets(b.column(4), words)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(sets, pa.binary())], names=["doc_id", "component", "parts", "part", "shingles"])
        release()

    members = docs.join(placed, docs["doc_id"] == placed["node"]).select("doc_id", "component", "parts", "part", "text")
    members = members.mapInArrow(to_sets, "doc_id long, component long, parts int, part int, shingles binary")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    paired = members.select("doc_id", "component", "part", "shingles", other.alias("other"))
    paired = paired.select("doc_id", "component", "shingles", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))

    def verify(table: pa.Table) -> pa.Table:
        ids = table["doc_id"].to_pylist()
        unique: dict[tuple, None] = dict.fromkeys(zip(ids, table["shingles"].to_pylist(), strict=True))
        links = linked([i for i, _ in unique], [np.frombuffer(s, np.uint64) for _, s in unique], k, percent)
        if len(unique) > 500:
            release()
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    links = paired.groupBy("component", "i", "j").applyInArrow(verify, "a long, b long")
    found = connected(cut(links)).withColumnRenamed("node", "rep")
    final = classes.join(found, "rep", "left").select("n", "f1", "f2", F.coalesce("component", "rep").alias("component"))
    out = seen.join(final, ["n", "f1", "f2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", *unpacked(extra, ["doc_id", "n_shingles", "component_id", "kept"]), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), words=4)


#: By brute force over all pairs that share a shingle: for small tables only.
OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, string_split(w, ' ') AS ws, w FROM (
    SELECT doc_id, array_to_string(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS w FROM documents)
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN w = '' THEN [] WHEN len(ws) < 4 THEN [w]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) END) AS g FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), h AS (
  SELECT doc_id, md5(string_agg(g, chr(1) ORDER BY g)) AS h FROM s GROUP BY doc_id
), c AS (
  SELECT h, min(doc_id) AS rep FROM h GROUP BY h
), r AS (
  SELECT s.doc_id, g FROM s JOIN c ON s.doc_id = c.rep
), i AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
  UNION ALL SELECT rep, doc_id FROM h JOIN c USING (h) WHERE rep <> doc_id
), u AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), t AS (
  SELECT a AS x, a AS y FROM u UNION SELECT t.x, u.b FROM t JOIN u ON t.y = u.a
), m AS (
  SELECT x, min(y) AS y FROM t GROUP BY x
)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(y, doc_id) AS component_id, coalesce(y, doc_id) = doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.x = doc_id
"""
