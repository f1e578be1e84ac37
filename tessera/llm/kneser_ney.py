"""Operator 2, quality classifier: perplexity under an interpolated modified Kneser-Ney model.

The model is over characters: words of running text are too often new for counts of
words, and a repeated, shouted or littered text is odd in its characters already.
ASCII is folded (one symbol for capitals, one for digits); every other code point is a
symbol of its own up to 2**15 of them, so all scripts are seen.

`crossed`, as the queries have it, a hash of the id deals the trusted documents to two
halves, and a model counts all of each: together they count every trusted document.  A
trusted document's mean log-probability is that under the half it is not in, any other's
the mean of both, and the thresholds come from all trusted documents.  Else there is one
model, of the first half, which scores all, and the second half is for the thresholds.
Only where `sample_docs` is given are at most so many trusted documents counted; the
others go to the thresholds.

Counts, continuation counts, discounts, context totals and probabilities of each
order are tables that are grouped and joined by n-gram, dealt by its hash.  The
n-grams that occur in the documents join them, back off where they are missing, and
get a log-probability each.  That table stays in shards: blocks of documents send
each shard their different n-grams, the shard joins them to its part of the table,
and the block adds the answers up by document.  Nothing of it comes to the driver
or goes to all tasks.

A document of n symbols deviates by (mean log-probability - the language's median)
* sqrt(n), which is comparable for short and long texts.  It is kept within
`stretch` times the `tail` and 1 - `tail` quantiles of its language's trusted
documents, each scored by a model that does not count it; languages with fewer than `least_docs` of those,
and null, use the quantiles of all.  Null and empty texts are rejected with a null perplexity.  With
no trusted document everything that has text is kept.  Extra columns pass through; one
named like a result comes out with `_in` after its name.  Repeated rows give repeated
results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import Exchange, blocked, deltas, expand, narrow, shard_of, sized, squeeze, sums, table_bytes
from .carry import REST, packed, unpacked
from .session import cut
from .textkit import Chunk, chunks, mix, release

BITS, SYMBOLS = 15, 1 << 15
NEWLINE = 29
#: Symbols of ASCII come first.
ASCII = 64
OWN = ["n_chars_scored", "perplexity", "deviation", "kept"]


def folding() -> np.ndarray:
    """The symbol of each ASCII character: letters, one for capitals, one for digits, white space, and marks."""
    t = np.full(128, 44, np.int64)
    t[97:123], t[65:91], t[48:58] = np.arange(1, 27), 27, 28
    t[32], t[9:14] = 0, NEWLINE
    for i, b in enumerate(b".,!?#*$%&|<>-'"):
        t[b] = 30 + i
    return t


FOLD = folding()


def symbols(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(the symbol of each character, where the documents' characters begin, and their number)."""
    lead = (c.data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    first = c.data[at].astype(np.int64)
    size = 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0).astype(np.int64)
    point = np.where(size == 1, first & 127, first & (0x7F >> size))
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if len(more):
            point[more] = point[more] << 6 | (c.data[np.minimum(at[more] + k, len(c.data) - 1)] & 0x3F)
    out = np.where(point < 128, FOLD[np.minimum(point, 127)], ASCII + point % (SYMBOLS - ASCII))
    return out, np.concatenate([[0], np.cumsum(lead)])[c.offsets]


def grams(c: Chunk, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(code of the n-gram that ends at each character, the documents' offsets); line ends stand before each document."""
    symbol, offsets = symbols(c)
    lengths = np.diff(offsets)
    padded = np.full(len(symbol) + (order - 1) * c.n, NEWLINE, np.int64)
    at = np.arange(len(symbol)) + np.repeat(np.arange(1, c.n + 1) * (order - 1), lengths)
    padded[at] = symbol
    code = np.zeros(len(at), np.int64)
    for j in range(order - 1, -1, -1):
        code = code << BITS | padded[at - j]
    return code, offsets


def gram_counts(docs: DataFrame, order: int, folds: int = 0) -> DataFrame:
    """(gram, c) over docs (__text): counted in each batch, then by hash of the n-gram.  With folds: (gram, c0, c1, ..), a count for each fold of docs (__text compressed, fold)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            parts, texts = [], b.column(0)
            if folds:
                texts = pa.array([None if t is None else z.decompress(t) for t in texts.to_pylist()], pa.large_binary())
            for c in chunks(texts):
                code, offsets = grams(c, order)
                for f in range(max(1, folds)):
                    own = code[np.repeat(b.column(1).to_numpy()[c.first : c.first + c.n] == f, np.diff(offsets))] if folds else code
                    found, n = np.unique(own, return_counts=True)
                    parts.append((found, n, np.full(len(found), f, np.int32)))
            if not parts:
                continue
            gram, n, fold = (np.concatenate(x) for x in zip(*parts, strict=True))
            by = np.lexsort((gram, fold))
            gram, n, fold = gram[by], n[by], fold[by]
            at = np.flatnonzero((np.diff(gram, prepend=-1) != 0) | (np.diff(fold, prepend=-1) != 0))
            gram, n, fold = gram[at], np.add.reduceat(n, at) if len(at) else n, fold[at]
            for i in range(0, len(gram), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 65536]) for x in (gram, n, fold)], names=["gram", "c", "fold"])
        release()

    counted = docs.select("__text", *["fold"][:folds]).mapInArrow(count, "gram long, c long, fold int").groupBy("gram")
    return counted.agg(*[F.sum(F.when(F.col("fold") == f, F.col("c")).otherwise(0)).alias(f"c{f}") for f in range(folds)] or [F.sum("c").alias("c")])


def with_ids(docs: DataFrame, ids: DataFrame, bits: int = 1 << 25) -> DataFrame:
    """(__text compressed, fold) of the rows of docs (doc_id, text) whose id is one of ids (doc_id, fold int), whose ids differ.

    A bit map of the ids' hashes, of bounded size, drops most other rows where they lie; the join is exact, and moves
    compressed texts where the ids are too many to send to all.
    """
    slot = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(bits))
    at, bit = F.floor(slot / 64).alias("__at"), F.pmod(slot, F.lit(64)).cast("int").alias("__bit")
    words = ids.select(at, bit).select("__at", F.expr("shiftleft(1L, __bit)").alias("__set")).groupBy("__at").agg(F.bit_or("__set").alias("__bits"))
    near = docs.select("doc_id", "text", at, bit).join(F.broadcast(words), "__at").where(F.getbit("__bits", F.col("__bit")) == 1)

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            texts = [None if t is None else z.compress(t) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.binary())], names=["doc_id", "text"])
        release()

    small = near.select("doc_id", "text").mapInArrow(shrink, "doc_id long, text binary")
    return small.join(ids, "doc_id").select(F.col("text").alias("__text"), "fold")


def last_of(gram: Column, n: int) -> Column:
    """The last n symbols of an n-gram."""
    return gram.bitwiseAND(F.lit((1 << BITS * n) - 1))


def context_of(gram: Column) -> Column:
    return F.shiftright(gram, BITS)


def model_tables(counts: DataFrame, order: int) -> tuple[dict[int, DataFrame], dict[int, DataFrame]]:
    """(probability of each n-gram seen, weight of the shorter n-gram after each context seen), by n.

    Each column of counts but gram, c and what follows it, is a model; what it has not seen is null in its columns.
    """
    models = [c[1:] for c in counts.columns if c != "gram"]
    of = lambda name, m: F.col(name + m)
    levels = {order: counts}
    for n in range(order, 1, -1):
        levels[n - 1] = levels[n].groupBy(last_of(F.col("gram"), n - 1).alias("gram")).agg(*[F.count_if(of("c", m) > 0).alias(f"c{m}") for m in models])
    probability, weight = {}, {}
    lower = counts.sparkSession.range(1).select(F.col("id").alias("low"), *[F.lit(1.0 / SYMBOLS).alias(f"below{m}") for m in models])
    for n in range(1, order + 1):
        t = levels[n]
        # at most four numbers a level and model come to the driver
        k = t.agg(*[F.count_if(of("c", m) == i) for m in models for i in (1, 2, 3, 4)]).first()
        discounts = {}
        for j, m in enumerate(models):
            n1, n2, n3, n4 = (max(1, x) for x in k[4 * j : 4 * j + 4])
            y = n1 / (n1 + 2 * n2)
            # a tenth at least: a context whose counts had none of it taken off would give nothing to what it has not seen
            d = [max(0.1, min(i, i - (i + 1) * y * b / a)) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
            discounts[f"d{m}"] = F.when(of("c", m) == 0, 0.0).when(of("c", m) == 1, d[0]).when(of("c", m) == 2, d[1]).otherwise(d[2])
        t = t.withColumns(discounts).withColumn("context", context_of(F.col("gram")))
        totals = t.groupBy("context").agg(*[x for m in models for x in (F.sum(of("c", m)).alias(f"total{m}"), F.try_divide(F.sum(of("d", m)), F.sum(of("c", m))).alias(f"w{m}"))])
        t = t.join(totals, "context").withColumn("low", last_of(F.col("gram"), n - 1)).join(lower, "low")
        p = [F.when(of("c", m) > 0, F.try_divide(of("c", m) - of("d", m), of("total", m)) + of("w", m) * of("below", m)).alias(f"p{m}") for m in models]
        probability[n] = cut(t.select("gram", *p))
        weight[n] = totals.select("context", *[f"w{m}" for m in models])
        lower = probability[n].select(F.col("gram").alias("low"), *[of("p", m).alias(f"below{m}") for m in models])
    return probability, weight


def log_probabilities(asked: DataFrame, counts: DataFrame, order: int) -> DataFrame:
    """(gram, logp) of the asked n-grams (gram), a column for each of counts, with the same end of its name."""
    probability, weight = model_tables(counts, order)
    models = [c[1:] for c in counts.columns if c != "gram"]
    out = asked.select("gram", *[F.lit(1.0 / SYMBOLS).alias(f"p{m}") for m in models])
    for n in range(1, order + 1):
        part = last_of(F.col("gram"), n)
        seen = probability[n].select(F.col("gram").alias("g"), *[F.col(f"p{m}").alias(f"q{m}") for m in models])
        after = weight[n].select(F.col("context").alias("x"), *[f"w{m}" for m in models])
        out = out.withColumns({"k": part, "h": context_of(part)}).join(seen, F.col("k") == F.col("g"), "left").join(after, F.col("h") == F.col("x"), "left")
        out = out.select("gram", *[F.coalesce(f"q{m}", F.coalesce(f"w{m}", F.lit(1.0)) * F.col(f"p{m}")).alias(f"p{m}") for m in models])
    return out.select("gram", *[F.log(f"p{m}").alias(f"logp{m}") for m in models])


def sharded(table: DataFrame, models: list[str], shards: int) -> DataFrame:
    """(shard, gram, models): each n-gram at the shard where blocks ask for it."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard = shard_of(mix(b.column(0).to_numpy().astype(np.uint64)), shards)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *b.columns], names=["shard", "gram", *models])

    return table.select("gram", *models).mapInArrow(deal, ", ".join(["shard int, gram long", *(f"{m} double" for m in models)]))


#: Steps of the log-probabilities in messages, for 1: a mean of them is out by less than 1.2e-10.
STEPS = 1 << 32


def stepped(logps: list[np.ndarray]) -> list[np.ndarray]:
    """Log-probabilities by each model as whole steps down from 0 and, after the first model, differences from it (2d, or -2d - 1 below 0)."""
    first, *other = [np.rint(x * -STEPS).astype(np.int64) for x in logps]
    return [narrow(first), *[narrow((x - first) << 1 ^ (x - first) >> 63) for x in other]]


def unstepped(sent: list[np.ndarray]) -> list[np.ndarray]:
    first, *other = [x.astype(np.int64) for x in sent]
    return [first / -STEPS, *[(first + (d >> 1 ^ -(d & 1))) / -STEPS for d in other]]


def scores(docs: DataFrame, columns: list[str], known: DataFrame, order: int, block_bytes: int = 3 << 19, shard_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, columns, __n (symbols) and a mean log-probability by each model (null without text) for each row of docs (doc_id, text, columns).

    known: (gram, its log-probability by each model) of all n-grams that occur.
    """
    models = [c for c in known.columns if c != "gram"]
    size = table_bytes(docs)
    blocks, _ = blocked(docs, columns, sized(docs, block_bytes))
    exchange = Exchange(blocks, max(64, math.ceil(size / shard_bytes)), size)
    shards = exchange.shards

    def different(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """(the block's n-grams by shard and code, their shards)."""
        parts = [np.unique(grams(c, order)[0]) for c in chunks(table["text"])]
        codes = np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int64)
        shard = shard_of(mix(codes.astype(np.uint64)), shards)
        by = np.argsort(shard, kind="stable")
        return codes[by], shard[by]

    def ask(table, answers, state):
        codes, shard = different(table)
        edges = np.flatnonzero(np.diff(shard, prepend=-1, append=-2)) if len(shard) else []
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            yield int(shard[i]), squeeze(deltas(codes[i:j].astype(np.uint64)))

    def look_up(messages, rows):
        gram = rows["gram"].to_numpy()
        by = np.argsort(gram)
        gram, logps = gram[by], [rows[m].to_numpy()[by] for m in models]
        for block, body in messages:
            at = np.searchsorted(gram, sums(expand(body)[0]).astype(np.int64))
            yield block, squeeze(*stepped([logp[at] for logp in logps]))

    def add(table, answers, state):
        codes, _ = different(table)
        by = np.argsort(codes)
        parts = [unstepped(expand(answers[s])) for s in sorted(answers)]
        codes, told = codes[by], [np.concatenate([p[i] for p in parts])[by] if parts else np.empty(0) for i in range(len(models))]
        n, means = [], [[] for _ in models]
        for c in chunks(table["text"]):
            code, offsets = grams(c, order)
            length, at = np.diff(offsets), np.searchsorted(codes, code)
            full = np.flatnonzero(length)
            for logp, m in zip(told, means, strict=True):
                s = np.zeros(c.n)
                if len(full):
                    s[full] = np.add.reduceat(logp[at], offsets[full])
                m.append(s / np.maximum(length, 1))
            n.append(length)
        n = np.concatenate(n)
        found = {name: pa.array(np.concatenate(m), pa.float64(), mask=n == 0) for name, m in zip(models, means, strict=True)}
        return pa.table({"doc_id": table["doc_id"], **{c: table[c] for c in columns}, "__n": pa.array(n, pa.int64()), **found})

    exchange.round(ask, look_up, sharded(known, models, shards))
    kinds = dict(blocks.dtypes)
    return exchange.finish(add, ", ".join(["doc_id long", *(f"`{c}` {kinds[c]}" for c in columns), "__n long", *(f"{m} double" for m in models)]))


def quantiles(values: DataFrame, fractions: list[float], bins: int) -> DataFrame:
    """(lang, docs, q): rows and exact quantiles, as percentile has them, of each language's x in values (lang, x).

    Counts of bins of width 1 / bins lead to those with the ranks asked for, so that only their different values are sorted.
    """
    counted = cut(values.groupBy("lang", "x").agg(F.count("*").alias("c")).withColumn("bin", F.floor(F.col("x") * bins)))
    up_to = Window.partitionBy("lang").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    b = counted.groupBy("lang", "bin").agg(F.sum("c").alias("n"))
    b = b.select("lang", "bin", "n", (F.sum("n").over(up_to) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("lang")).alias("docs"))
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f).alias("f")) for i, f in enumerate(fractions)])).alias("a")
    b = b.select("*", at).withColumn("place", (F.col("docs") - 1) * F.col("a.f"))
    b = b.select("*", F.explode(F.array(F.floor("place"), F.ceil("place"))).alias("rank")).where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
    asked = b.select(F.col("lang").alias("of"), F.col("bin").alias("at"), "before", "docs", "place", "rank", "a.i").distinct()
    near = asked.select("of", "at", "before").distinct()
    near = counted.join(F.broadcast(near), F.col("lang").eqNullSafe(F.col("of")) & (F.col("bin") == F.col("at")))
    near = near.select("of", "at", "x", "c", (F.col("before") + F.sum("c").over(Window.partitionBy("of", "at").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))).alias("end"))
    same = F.col("a.of").eqNullSafe(F.col("n.of")) & (F.col("a.at") == F.col("n.at"))
    found = asked.alias("a").join(near.alias("n"), same).where((F.col("end") - F.col("c") <= F.col("rank")) & (F.col("rank") < F.col("end")))
    share = F.col("place") - F.floor("place")
    found = found.groupBy(F.col("a.of").alias("lang"), "docs", "i").agg((F.min("x") * (1 - F.first(share)) + F.max("x") * F.first(share)).alias("v"))
    return found.groupBy("lang", "docs").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda y: y["v"]).alias("q"))


def held_out(ids: DataFrame, crossed: bool, sample_docs: int | None) -> DataFrame:
    """(doc_id, fold) of ids (doc_id): the model that counts the document, null if none does."""
    half = F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(2)).cast("int")
    fold = half if crossed else F.when(half == 0, half)
    if sample_docs is None:
        return ids.withColumn("fold", fold)
    chosen = ids.orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").limit(sample_docs).withColumn("fold", fold)
    return ids.join(chosen, "doc_id", "left")


def quality_classifier(docs: DataFrame, trusted: DataFrame, order: int = 4, sample_docs: int | None = None, tail: float = 0.005, stretch: float = 1.75, least_docs: int = 50, columns: list[str] | None = None, crossed: bool = False) -> DataFrame:
    """columns, n_chars_scored, perplexity, deviation and kept for each row of docs (doc_id, text, lang, columns); trusted: (doc_id)."""
    columns = columns or ["doc_id", "lang"]
    shown = unpacked(columns, OWN)
    ids = trusted.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    folds = cut(held_out(ids, crossed, sample_docs))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("__lang"), packed(columns))
    halves = [0, 1] if crossed else [0]
    counts = cut(gram_counts(with_ids(texts, folds.where(F.col("fold").isNotNull())), order, len(halves)))
    # models that have seen something
    some = counts.agg(*[F.coalesce(F.bool_or(F.col(f"c{h}") > 0), F.lit(False)) for h in halves]).first()
    models = [h for h in halves if some[h]]
    if not models:
        none = F.lit(None).cast("double")
        has = F.coalesce(F.length("text") > 0, F.lit(False))
        return texts.select(*shown, F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars_scored"), none.alias("perplexity"), none.alias("deviation"), has.alias("kept"))
    asked = gram_counts(texts.select(F.col("text").alias("__text")), order).select("gram")
    known = log_probabilities(asked, counts.select("gram", *[f"c{h}" for h in models]), order)
    scored = cut(scores(texts, ["__lang", REST], known, order))
    # rows without an id would meet in one task of the join
    scored = scored.where(F.col("doc_id").isNotNull()).join(folds.withColumn("__trusted", F.lit(True)), "doc_id", "left").unionByName(scored.where(F.col("doc_id").isNull()), allowMissingColumns=True)
    fold, m = F.col("fold"), [F.col(f"logp{h}") for h in models]
    if len(models) == 2:
        mean, calm = F.when(fold == 0, m[1]).when(fold == 1, m[0]).otherwise((m[0] + m[1]) / 2), F.col("__trusted")
    else:
        mean, calm = m[0], F.col("__trusted") & F.coalesce(fold != models[0], F.lit(True))
    scored = scored.select("__lang", REST, "__n", mean.alias("__m"), calm.alias("__calm"))
    calm = cut(scored.where(F.col("__calm") & F.col("__m").isNotNull()).select(F.col("__lang").alias("lang"), F.col("__m").alias("m"), F.col("__n").alias("n")))
    everywhere = calm.where(F.col("lang").isNotNull()).unionByName(calm.withColumn("lang", F.lit(None).cast("string")))
    median = quantiles(everywhere.select("lang", F.col("m").alias("x")), [0.5], 10000).select("lang", "docs", F.col("q")[0].alias("mu"))
    same = F.col("c.lang").eqNullSafe(F.col("d.lang"))
    dev = everywhere.alias("c").join(F.broadcast(median).alias("d"), same).select("c.lang", ((F.col("m") - F.col("mu")) * F.sqrt("n")).alias("x"))
    bounds = quantiles(dev, [tail, 1 - tail], 100).select(F.col("lang").alias("of"), F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    bounds = median.join(bounds, F.col("lang").eqNullSafe(F.col("of"))).select("lang", "mu", "docs", (stretch * F.col("lo")).alias("low"), (stretch * F.col("hi")).alias("high"))
    # a row a language with enough documents
    rows = bounds.where((F.col("docs") >= least_docs) | F.col("lang").isNull()).collect()
    overall = next((r for r in rows if r["lang"] is None), None)
    bound = F.broadcast(docs.sparkSession.createDataFrame([(r["lang"], r["mu"], r["low"], r["high"]) for r in rows if r["lang"] is not None], "__own string, __mu double, __low double, __high double"))
    out = scored.join(bound, F.col("__lang") == F.col("__own"), "left")
    limit = lambda c: F.coalesce(F.col(f"__{c}"), F.lit(overall[c] if overall else None).cast("double"))
    z = (F.col("__m") - limit("mu")) * F.sqrt("__n")
    kept = F.coalesce((z >= limit("low")) & (z <= limit("high")), F.col("__m").isNotNull() if overall is None else F.lit(False))
    return out.select(*shown, F.col("__n").alias("n_chars_scored"), F.exp(-F.col("__m")).alias("perplexity"), z.alias("deviation"), kept.alias("kept"))


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents of good quality that are not toxic."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select("doc_id")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    out = quality_classifier(docs, trusted_ids(spark, sf_dir), crossed=True)
    return out.withColumns({c: F.round(c, 6) for c in ("perplexity", "deviation")})
