"""Operator 9, exact top-k search by multi-resolution segment statistics.

Vectors are turned into a basis in which their energy comes first (of a sample's
second moments; any orthonormal basis keeps products) and cut into 1, 4, 16 and 32
segments.  With the mean and the deviation of each segment, the distance of two
vectors is at least the root of
  sum over segments of length * (mean - mean')**2 + (deviation - deviation')**2
and an inner product is (|q|**2 + |c|**2 - distance**2) / 2, so a lower bound of
the distance bounds the score from above.

1. A sample of candidates, bounded by `sample_values` numbers, gives every query a
   first threshold: its k-th best score there, which its true one cannot be below.
2. Vectors are dealt to blocks by the nearest of at most `PIVOTS` sample vectors,
   full pivots to several blocks.  Before any vector is sent, the blocks' summaries
   (least and greatest statistics) bound the scores of a query with a whole block;
   only blocks of queries and candidates with a pair left in reach meet.  Small blocks
   of neighbouring pivots travel in one bundle: a bundle of queries and one of
   candidates meet once, with those of their blocks that reach one of the other's.
3. There candidates whose bound is below a query's threshold go, coarse statistics
   first, finer ones for what is left, and the survivors alone get exact integer
   products; the thresholds rise as better ones are found.  A block's k best ids of
   each query go on.

Nothing is approximate, and vectors without structure merely prune nothing.

Vectors that are null or hold null or non-finite components, rows without an id,
and vectors whose quantised squared length is 2**62 or more, so that products need
not fit a long, take no part.  Only vectors of equal length are compared; empty
vectors have products of 0.  Rows with one id are one candidate, with its best
score; a query is never its own candidate.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .session import cut

RESOLUTIONS = (1, 4, 16, 32)
#: The resolution of block summaries.
SUMMARY = 16
PIVOTS = 256


def quantised(vectors: DataFrame, id_column: str, vector_column: str, scale: float) -> DataFrame:
    """(id, v) with v: floor(scale * x) of each component, valid vectors only."""
    v = F.col(vector_column)
    whole = v.isNotNull() & F.col(id_column).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    out = vectors.where(whole).select(F.col(id_column).cast("long").alias("id"), F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"))
    return out.where(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) < 2.0**62)


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """For each row the roots of length times mean, then the deviations: their distance bounds that of the rows from below."""
    parts = np.array_split(x, min(segments, x.shape[1]), axis=1)
    means = [p.mean(axis=1) * math.sqrt(p.shape[1]) for p in parts]
    devs = [np.sqrt(np.maximum((p * p).sum(axis=1) - m * m, 0)) for p, m in zip(parts, means, strict=True)]
    return np.stack(means + devs, axis=1)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def one_each(scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids with the best score of each."""
    order = np.lexsort((scores, ids))
    last = order[np.append(ids[order][1:] != ids[order][:-1], True)] if len(order) else order
    return scores[last], ids[last]


def pyramid(x: np.ndarray) -> list[np.ndarray]:
    """The statistics of rows at each resolution, coarse to fine."""
    return [statistics(x, s) for s in RESOLUTIONS if s == 1 or s <= x.shape[1]] if x.shape[1] else []


def search_block(queries: tuple[np.ndarray, np.ndarray], candidates: tuple[np.ndarray, np.ndarray], k: int, floors: np.ndarray | None = None, basis: np.ndarray | None = None, tile: int = 2048) -> tuple[list[tuple[int, int, int]], int]:
    """((query id, candidate id, score) of each query's k best ids of the block, number of exact products).

    floors: for each query a score that its k-th best of all is not below.  basis: an orthonormal one, for the bounds.
    """
    qid, q = queries
    cid, c = candidates
    if not len(qid) or not len(cid):
        return [], 0
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1]) < 2**53
    qf, cf = q.astype(np.float64), c.astype(np.float64)
    turn = (lambda x: x @ basis) if basis is not None else (lambda x: x)
    slack = 1e-9 * (1 + (qf * qf).sum(axis=1).max(initial=0) + (cf * cf).sum(axis=1).max(initial=0))
    several = len(np.unique(cid)) < len(cid)
    stats = list(zip(pyramid(turn(qf)), pyramid(turn(cf)), strict=True))
    held = [(np.empty(0, object if not exact else np.int64), np.empty(0, np.int64)) for _ in qid]
    floor = np.full(len(qid), -np.inf) if floors is None else floors.astype(np.float64)
    scored = 0
    for at in range(0, len(cid), tile):
        part = slice(at, at + tile)
        alive = cid[part][None, :] != qid[:, None]
        for sq, sc in stats:
            rows, cols = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
            if not len(rows):
                break
            # the bound of the score: half of |q|^2 + |c|^2 - distance^2, which is the product of the statistics, as their norms are those of the vectors
            bound = sq[rows] @ sc[part][cols].T
            alive[np.ix_(rows, cols)] &= bound + slack >= floor[rows][:, None]
        own, own_q = c[part], cf[part]
        for row in np.flatnonzero(alive.any(axis=1)):
            on = np.flatnonzero(alive[row])
            scored += len(on)
            # survivors alone; a run of nearly all is read in place
            s = np.rint((own_q @ qf[row])[on] if 4 * len(on) > 3 * len(own) else own_q[on] @ qf[row]).astype(np.int64) if exact else own[on].astype(object) @ q[row].astype(object)
            s, n = np.concatenate([held[row][0], s]), np.concatenate([held[row][1], cid[part][on]])
            if several:
                s, n = one_each(s, n)
            top = best(s, n, k) if exact else np.lexsort((n, np.array([-x for x in s], object)))[:k]
            held[row] = s[top], n[top]
            if len(top) == k:
                floor[row] = max(floor[row], float(s[top[-1]]))
    return [(int(a), int(n), int(s)) for a, (ss, ns) in zip(qid, held, strict=True) for s, n in zip(ss, ns, strict=True)], scored


def by_length(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) by the vectors' length."""
    if not table.num_rows:
        return {}
    lists = table["v"].combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return {int(n): (on, flat[begin[on][:, None] + np.arange(n)[None, :]]) for n in np.unique(lengths) for on in [np.flatnonzero(lengths == n)]}


def arrays(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) by the vectors' length."""
    ids = table["id"].to_numpy()
    return {n: (ids[on], v) for n, (on, v) in by_length(table).items()}


def neighbours(x: np.ndarray) -> np.ndarray:
    """An order of rows in which near ones are near: halves along the main axis, again and again."""
    if len(x) <= 2:
        return np.arange(len(x))
    f = x - x.mean(axis=0)
    order = np.argsort(f @ np.linalg.svd(f, full_matrices=False)[2][0], kind="stable")
    half = len(x) // 2
    return np.concatenate([order[:half][neighbours(x[order[:half]])], order[half:][neighbours(x[order[half:]])]])


class Guide:
    """What a bounded sample of the candidates tells: for each length of vectors its members, an energy-ordered basis, and pivots."""

    def __init__(self, sample: pa.Table, pivots: int):
        self.held = {}
        for n, (ids, v) in arrays(sample).items():
            _, first = np.unique(ids, return_index=True)  # one vector an id: fewer can only lower a threshold
            self.held[n] = ids[first], v[first]
        self.basis, self.pivots = {}, {}
        for n, (_, v) in self.held.items():
            f = v.astype(np.float64)
            if n > 1 and len(f) >= 2 * n:
                self.basis[n] = np.linalg.eigh(f.T @ f)[1][:, ::-1].copy()
            self.pivots[n] = f[:pivots][neighbours(f[:pivots])] if n else f[:pivots]

    def pivot(self, v: np.ndarray) -> np.ndarray:
        """The nearest pivot of each vector."""
        p = self.pivots.get(v.shape[1])
        if p is None or not len(v):
            return np.zeros(len(v), np.int64)
        f = v.astype(np.float64)
        return np.argmin((p * p).sum(axis=1)[None, :] - 2 * (f @ p.T), axis=1)

    def summary(self, v: np.ndarray) -> np.ndarray:
        n = v.shape[1]
        f = v.astype(np.float64)
        return statistics(f @ self.basis[n] if n in self.basis else f, SUMMARY) if n else np.zeros((len(v), 1))

    def floors(self, ids: np.ndarray, v: np.ndarray, k: int) -> np.ndarray:
        """For each query just below the k-th best score among the sample's other ids, -inf if they are fewer."""
        out = np.full(len(ids), -np.inf)
        cid, c = self.held.get(v.shape[1], (np.empty(0, np.int64), None))
        if len(cid) <= k:
            return out
        f, c = v.astype(np.float64), c.astype(np.float64)
        far = (c * c).sum(axis=1).max()
        for i in range(0, len(ids), 512):
            part = slice(i, i + 512)
            scores = f[part] @ c.T
            scores[ids[part][:, None] == cid[None, :]] = -np.inf
            kth = np.partition(scores, len(cid) - k, axis=1)[:, len(cid) - k]
            out[part] = kth - 1e-9 * (1 + (f[part] * f[part]).sum(axis=1) + far)
        return out


def topk_search(vectors: DataFrame, queries: DataFrame, k: int = 5, query_rows: int = 1024, candidate_rows: int = 2048, sample_values: int = 1 << 18, with_scored: bool = False) -> DataFrame:
    """query_id, rank, vec_id and score: the k highest inner products of each of queries (id, v) with vectors (id, v).

    with_scored: in place of the result, for each pair of bundles that met, its pairs of vectors (met) and how many of them were scored.
    """
    spark = vectors.sparkSession
    queries, vectors = queries.select("id", "v").distinct(), vectors.select("id", "v").distinct()
    longest = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    rows = max(4 * k, sample_values // max(1, longest))
    # at most sample_values numbers, or 4 k vectors: bounded whatever the input
    guide = Guide(vectors.orderBy(F.xxhash64(F.lit(13), "id", "v"), "id").limit(rows).toArrow(), PIVOTS)
    known = spark.sparkContext.broadcast(guide)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            for n, (ids, v) in arrays(t).items():
                p = known.value.pivot(v)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * n, pa.int32()), pa.array(v.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists, pa.array(np.full(len(ids), n), pa.int32()), pa.array(p, pa.int32())], names=["id", "v", "n", "pivot"])

    def blocks(df: DataFrame, most: int) -> DataFrame:
        """id, v, n, block and bundle: blocks of at most about `most` vectors near one pivot, in bundles of at most about twice as many."""
        placed = df.mapInArrow(place, "id long, v array<long>, n int, pivot int")
        # a window of at most PIVOTS rows
        before = F.sum(F.when(F.col("rows") < most, F.col("rows")).otherwise(0)).over(Window.partitionBy("n").orderBy("pivot").rowsBetween(Window.unboundedPreceding, -1))
        sizes = placed.groupBy("n", "pivot").agg(F.count("*").alias("rows"))
        parts = sizes.select("n", "pivot", F.ceil(F.col("rows") / most).alias("parts"), F.when(F.col("rows") < most, F.floor(F.coalesce(before, F.lit(0)) / most)).alias("run"))
        dealt = placed.join(parts, ["n", "pivot"]).withColumn("part", F.pmod(F.xxhash64("id", "v"), F.col("parts")))
        block = F.xxhash64("n", "pivot", "part")
        return dealt.select("id", "v", "n", block.alias("block"), F.when(F.col("run").isNull(), block).otherwise(F.xxhash64("n", "run")).alias("bundle"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, out = pa.Table.from_batches([b]), []
            blocks_, bundles = t["block"].to_numpy(), t["bundle"].to_numpy()
            for n, (on, v) in by_length(t).items():
                s = known.value.summary(v)
                order = np.argsort(blocks_[on], kind="stable")
                own, bundle = blocks_[on][order], bundles[on][order]
                edges = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                out += [(int(k), n, int(w), x.tolist(), y.tolist()) for k, w, x, y in zip(own[edges], bundle[edges], np.minimum.reduceat(s[order], edges), np.maximum.reduceat(s[order], edges), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.int64()), *[pa.array([r[i] for r in out], pa.list_(pa.float64())) for i in (3, 4)]], names=["block", "n", "bundle", "low", "high"])

    def merged(key: tuple, table: pa.Table) -> pa.Table:
        low, high = (np.array(table[c].to_pylist()) for c in ("low", "high"))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([key[1].as_py()], pa.int32()), "bundle": pa.array([key[2].as_py()], pa.int64()), "low": pa.array([low.min(axis=0).tolist()], pa.list_(pa.float64())), "high": pa.array([high.max(axis=0).tolist()], pa.list_(pa.float64()))})

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            floors, ids = np.full(t.num_rows, -np.inf), t["id"].to_numpy()
            for on, v in by_length(t).values():
                floors[on] = known.value.floors(ids[on], v, k)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(floors, pa.float64())], names=["id", "v", "n", "block", "bundle", "floor"])

    c, q = blocks(vectors, candidate_rows), cut(blocks(queries, query_rows).mapInArrow(seeded, "id long, v array<long>, n int, block long, bundle long, floor double"))
    summary = "block long, n int, bundle long, low array<double>, high array<double>"
    summaries = cut(c.mapInArrow(summed, summary).groupBy("block", "n", "bundle").applyInArrow(merged, summary))
    # queries and summaries meet in a grid of cells; summaries are a thousandth of the candidates
    n_q, n_s = (max(1, math.ceil(x.count() / 4096)) for x in (q, summaries))
    cell = lambda df, n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    asked = q.select("id", "v", "n", "block", "bundle", "floor", cell(q, n_q).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(n_s - 1))).alias("j"))
    offered = summaries.select("*", cell(summaries, n_s).alias("j"), F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("i"))

    def reach(left: pa.Table, right: pa.Table) -> pa.Table:
        """Pairs of blocks with a query and a candidate in reach, and their bundles."""
        pairs: set[tuple[int, int, int, int]] = set()
        if left.num_rows and right.num_rows:
            blocks_, bundles, floor = left["block"].to_numpy(), left["bundle"].to_numpy(), left["floor"].to_numpy()
            lengths = right["n"].to_numpy()
            for n, (on, v) in by_length(left).items():
                near = right.take(pa.array(np.flatnonzero(lengths == n)))
                if not near.num_rows:
                    continue
                sq, names, others = known.value.summary(v), near["block"].to_numpy(), near["bundle"].to_numpy()
                low, high = (np.array(near[x].to_pylist()) for x in ("low", "high"))
                slack = 1e-9 * (1 + (sq * sq).sum(axis=1).max() + np.maximum(low * low, high * high).sum(axis=1).max())
                bound = np.maximum(sq, 0) @ high.T + np.minimum(sq, 0) @ low.T
                rows, cols = np.nonzero(bound + slack >= floor[on][:, None])
                pairs.update(zip(blocks_[on][rows].tolist(), names[cols].tolist(), bundles[on][rows].tolist(), others[cols].tolist(), strict=True))
        return pa.table({x: pa.array([p[i] for p in pairs], pa.int64()) for i, x in enumerate(("qb", "cb", "i", "j"))})

    cells = cut(asked.groupBy("i", "j").cogroup(offered.groupBy("i", "j")).applyInArrow(reach, "qb long, cb long, i long, j long").distinct())
    left = q.withColumnRenamed("block", "qb").join(cells.select("qb", "i", "j").distinct(), "qb").select("i", "j", "id", "v", "floor")
    right = c.withColumnRenamed("block", "cb").join(cells.select("cb", F.col("i").alias("x"), F.col("j").alias("y")).distinct(), "cb").select("x", "y", "id", "v")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        other, ids, floor = arrays(right), left["id"].to_numpy(), left["floor"].to_numpy()
        found, scored, met = [], 0, 0
        for n, (on, v) in by_length(left).items():
            if n in other:
                r, s = search_block((ids[on], v), other[n], k, floor[on], known.value.basis.get(n))
                found += r
                scored += s
                met += len(v) * len(other[n][0])
        if with_scored:
            return pa.table({"met": pa.array([met], pa.int64()), "scored": pa.array([scored], pa.int64())})
        return pa.table({n: pa.array([r[i] for r in found], pa.int64()) for i, n in enumerate(("query_id", "vec_id", "score"))})

    met = left.groupBy("i", "j").cogroup(right.groupBy("x", "y"))
    if with_scored:
        return met.applyInArrow(meet, "met long, scored long")
    found = met.applyInArrow(meet, "query_id long, vec_id long, score long")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", 256.0)
    return topk_search(vectors, vectors.where(F.col("id") % 50 == 0))


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, max(list_dot_product(q.v, c.v))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0 GROUP BY ALL
)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s)
WHERE rank <= 5
"""
