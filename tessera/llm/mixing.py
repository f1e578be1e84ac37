"""Operator 10, mixing sources to target weights: DataFrame functions only.

Sources get targets by weight, no more than `most` times their size; what is
above goes to the others by weight.  Hashes deal each source's documents to
blocks and put the blocks in a random order.  The mix takes every block as often
as the target holds the whole source, and once more a run of the permuted blocks
up to the target; inside the run's last block documents go by hash while they fit,
then the one whose size is nearest to what is still open.

The draws of blocks are dealt to output shards by a multivariate-hypergeometric
splitting tree: a node's quotas by source split in two halves as if its slots
were shuffled, which fixes how many of each source's draws every shard gets, and
the shards take disjoint runs of the permuted draws.  A hash orders each shard.

Blocks and shards grow with the table (`block_docs`, `shard_docs`), so that neither
the block that is cut nor a shard does.  One row a source, and a row a block of one
source, meet in one task: sources are taken to be few (thousands), and a source has
at most `MOST_BLOCKS` blocks.

Null texts have size 0 and are taken 0 times their words; a null source is a
source, the last.  Documents of a source without words are never taken.  Extra
columns pass through `mixed` untouched.  Equal rows are counted each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .session import cut
from .textkit import WORD


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """(source, source_size) to source_size and target.

    Water-filling: with sources by cap / weight, the first k are at their cap and
    the rest share what is left by weight, for the smallest k where none is above.
    One row a source meets in one task, never rows of documents.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.expr(f"cast((rank - 1) % {len(weights)} + 1 as int)"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", w).withColumn("cap", most * F.col("source_size").cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = share * F.sum("source_size").over(everything)
    level = ranked.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # the level of the first source that is below its cap holds for all after it
    fits = level.withColumn("free", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")))
    final = F.first("free", ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return fits.withColumn("target", F.coalesce(F.least(final * F.col("weight"), F.col("cap")), F.col("cap"))).select("source", "rank", "source_size", "target")


def split_tree(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """(rank, draws) to (rank, shard, draws): a multivariate-hypergeometric split at each node of a binary tree."""
    nodes = quotas.groupBy().agg(F.sort_array(F.collect_list(F.struct("rank", "draws"))).alias("q")).select(F.lit(0).cast("long").alias("node"), "q")
    # sources come one after another, and the slots still open depend on the picks before: the fold runs inside one array
    for level in range(levels):
        nodes = nodes.withColumn("left", F.expr(_fold(level, seed)))
        nodes = nodes.select(
            F.explode(
                F.array(
                    F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("q")),
                    F.struct((F.col("node") * 2 + 1).alias("node"), F.expr("transform(q, (x, i) -> named_struct('rank', x.rank, 'draws', x.draws - left[i].draws))").alias("q")),
                )
            ).alias("c")
        ).select("c.*")
    return nodes.select("node", F.explode("q").alias("x")).select(F.col("x.rank").alias("rank"), F.col("node").alias("shard"), F.col("x.draws").alias("draws"))


def _fold(level: int, seed: int) -> str:
    """SQL for the left child's quotas of a node with quotas q: array<struct<rank, draws>>."""

    def bind(body: str, **values: str) -> str:
        """body with names for values, each worked out once."""
        for name, value in reversed(values.items()):
            body = f"transform(array({value}), {name} -> {body})[0]"
        return body

    # of total balls, x.draws of this source, n go left: weights relative to the likeliest number's, walked up from it, then down
    ratio = "(cast(x.draws - k as double) * (s.n - k)) / (cast(k + 1 as double) * (s.total - x.draws - s.n + k + 1))"
    mass = "aggregate({ks}, named_struct('p', 1D, 'c', 0D), (a, k) -> bind_p).c"
    grow, shrink = f"a.p * {ratio}", f"a.p / ({ratio})"
    add = lambda p: f"transform(array({p}), p -> named_struct('p', p, 'c', a.c + p))[0]"
    pick = lambda p, k: f"transform(array({p}), p -> named_struct('p', p, 'c', a.c + p, 'k', if(a.k >= 0, a.k, if(want < a.c + p, {k}, -1L))))[0]"
    choice = bind(
        "coalesce(nullif(aggregate(rising, named_struct('p', 1D, 'c', 1D, 'k', if(want < 1D, mode, -1L)), (a, k) -> " + pick(grow, "k + 1") + ").k, -1L), "
        "nullif(aggregate(falling, named_struct('p', 1D, 'c', 1D + above, 'k', -1L), (a, k) -> " + pick(shrink, "k") + ").k, -1L), mode)",
        low="greatest(0L, s.n - (s.total - x.draws))",
        high="least(s.n, x.draws)",
        mode="least(greatest(cast(floor(cast(s.n + 1 as double) * (x.draws + 1) / (s.total + 2)) as bigint), low), high)",
        rising="filter(sequence(low, high), k -> k >= mode and k < high)",
        falling="reverse(filter(sequence(low, high), k -> k < mode))",
        above=mass.format(ks="rising").replace("bind_p", add(grow)),
        below=mass.format(ks="falling").replace("bind_p", add(shrink)),
        want=f"(pmod(xxhash64({seed}, {level}, node, x.rank), 9007199254740992L) / 9007199254740992D) * (1D + above + below)",
    )
    step = bind("named_struct('total', s.total - x.draws, 'n', s.n - y, 'out', concat(s.out, array(named_struct('rank', x.rank, 'draws', y))))", y=choice)
    total = "aggregate(q, 0L, (t, x) -> t + x.draws)"
    start = f"named_struct('total', {total}, 'n', {total} div 2, 'out', filter(transform(q, x -> named_struct('rank', x.rank, 'draws', x.draws)), x -> false))"
    return f"aggregate(q, {start}, (s, x) -> {step}, s -> s.out)"


#: Blocks of a source, at most.
MOST_BLOCKS = 1 << 20


def doubled(least: int, want: float, most: int) -> int:
    """The least power of two times `least` that is `want` or more, at most `most`."""
    return min(most, least << max(0, math.ceil(math.log2(max(1.0, want / least)))))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, blocks: int = 1024, levels: int = 4, seed: int = 29, carry: list[str] | None = None, block_docs: int = 512, shard_docs: int = 1 << 13) -> DataFrame:
    """__row (a struct of the columns in carry, all if None) for each row of docs (source, text, ...), with size, source_size,
    target, copies, shards: the output shards its copies go to, and place: its order in a shard.

    blocks, levels: the least number of blocks, and of halvings into shards; more if they would hold over block_docs or shard_docs documents.
    """
    keep = docs.columns if carry is None else carry
    rows = docs.count()
    blocks = doubled(blocks, rows / block_docs, MOST_BLOCKS)
    levels = doubled(1 << levels, rows / shard_docs, 1 << 14).bit_length() - 1
    order = F.xxhash64(F.lit(seed), "__key", "size")
    sized = docs.select(F.struct(*keep).alias("__row"), F.col("source").cast("string").alias("source"), words(F.col("text").cast("string")).alias("size"), (F.col("doc_id") if "doc_id" in docs.columns else F.xxhash64("text")).alias("__key"))
    dealt = sized.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "__key", "size"), F.lit(blocks)).cast("int"))
    if "text" not in keep:
        dealt = cut(dealt)  # narrow rows: cheaper to keep than to read and count the texts again
    by_block = cut(dealt.groupBy("source", "block").agg(F.sum("size").alias("block_size"), F.count("*").alias("docs")))
    targets = source_targets(by_block.groupBy("source").agg(F.sum("block_size").alias("source_size")), weights, share, most)
    # a power of two of blocks a source, of about 64 documents or more: small sources still have choice in the block that is cut
    enough = F.greatest(F.lit(0.0), F.least(F.lit(float(blocks.bit_length() - 1)), F.floor(F.log2(F.sum("docs") / 64.0))))
    merged = by_block.groupBy("source").agg(F.pow(F.lit(2.0), enough).cast("int").alias("parts"))
    targets = cut(targets.alias("t").join(merged.alias("m"), F.col("t.source").eqNullSafe(F.col("m.source"))).select("t.*", "parts"))
    fine = cut(by_block.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.source", "block", "block_size", "rank", "source_size", "target", (F.col("block") % F.col("parts")).alias("part")))

    permuted = Window.partitionBy("rank").orderBy(F.xxhash64(F.lit(seed + 2), "rank", "part"), "part")
    plan = fine.groupBy("rank", "part").agg(F.sum("block_size").alias("part_size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("copies", whole.cast("int")).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    plan = plan.withColumn("at", F.row_number().over(permuted)).withColumn("through", F.sum("part_size").over(permuted.rowsBetween(Window.unboundedPreceding, 0)))
    plan = plan.withColumn("room", F.when(F.col("through") <= F.col("rest"), F.lit(None)).otherwise(F.greatest(F.lit(0.0), F.col("rest") - (F.col("through") - F.col("part_size")))))
    # room null: the whole block once more; 0: not; else documents by hash up to it
    drawn = plan.withColumn("draws", (F.col("copies") + F.when(F.col("room").isNull() | (F.col("room") > 0), 1).otherwise(0)).cast("long"))
    first = Window.partitionBy("rank").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    drawn = cut(drawn.withColumn("draw", F.coalesce(F.sum("draws").over(first), F.lit(0))))

    runs = split_tree(drawn.groupBy("rank").agg(F.sum("draws").alias("draws")), levels, seed + 3)
    ends = F.sum("draws").over(Window.partitionBy("rank").orderBy("shard"))
    runs = runs.withColumn("upto", ends).groupBy("rank").agg(F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("runs"))
    shard_of = "transform(filter(sequence(draw, draw + draws), d -> d < draw + draws), d -> element_at(filter(runs, r -> d < r.upto), 1).shard)"
    drawn = drawn.join(runs, "rank", "left").select("rank", "part", "copies", "room", F.expr(shard_of).alias("shards"))
    fine = fine.join(drawn, ["rank", "part"]).select("source", "block", "part", "source_size", "target", "copies", "room", "shards")

    # only blocks that are cut need an order of their documents; the others skip the window
    joined = dealt.alias("d").join(fine.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.block") == F.col("p.block")))
    joined = joined.select("__row", "size", "__key", "d.source", "part", "source_size", "target", "copies", "room", "shards")
    block = Window.partitionBy("source", "part")
    inside = block.orderBy(order, "__key").rowsBetween(Window.unboundedPreceding, 0)
    cut_block = F.col("room") > 0
    edge = joined.where(cut_block).withColumn("through", F.sum("size").over(inside)).withColumn("fits", F.col("through") <= F.col("room"))
    edge = edge.withColumn("gap", F.col("room") - F.coalesce(F.max(F.when(F.col("fits"), F.col("through"))).over(block), F.lit(0)))
    off = F.abs(F.col("gap") - F.col("size"))
    nearest = F.row_number().over(Window.partitionBy("source", "part", "fits").orderBy(off, order, "__key"))
    edge = edge.withColumn("extra", F.when(F.col("fits") | ((nearest == 1) & (off < F.col("gap"))), 1).otherwise(0)).drop("through", "fits", "gap")
    rest = joined.where(~cut_block | F.col("room").isNull()).withColumn("extra", F.col("room").isNull().cast("int"))
    out = rest.unionByName(edge).withColumn("copies", F.when(F.col("source_size") > 0, F.col("copies") + F.col("extra")).otherwise(0).cast("int"))
    return out.select("__row", "size", "source_size", "target", "copies", F.slice("shards", F.lit(1), F.greatest(F.col("copies"), F.lit(0))).alias("shards"), order.alias("place"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    out = mixed(docs, carry=["doc_id"])
    return out.select(F.col("__row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "shards")
