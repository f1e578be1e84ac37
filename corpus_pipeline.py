"""A corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs.  All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.graph import HUBS, with_least
from tessera.llm.kneser_ney import quality_classifier, trusted_ids
from tessera.llm.minhash import near_duplicates
from tessera.llm.mixing import mixed
from tessera.llm.packing import pack, vocabulary
from tessera.llm.session import cut, discard, written
from tessera.llm.suffix_dedup import suffix_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps.

    Its verdict is one of id, text and language: keys of these go with the scores, the texts stay where they are until then.
    """
    keys = ["__k1", "__k2"]
    parts = ["doc_id", "text", "lang"]
    named = docs.select(*COLUMNS, F.xxhash64(*parts).alias(keys[0]), F.xxhash64(F.lit(1), *parts).alias(keys[1]))
    scored = quality_classifier(named, trusted_ids(spark, sf_dir), columns=keys, crossed=True)
    return named.join(scored.where("kept").select(*keys).distinct(), keys, "left_semi").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates; rows without an id stay.

    An id with different texts is as many documents: they go by a hash of id and text.
    """
    node = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")).alias("node")
    found = near_duplicates(docs.select(node.alias("doc_id"), F.col("doc_id").alias("own"), "text"), columns=["own"])
    found = cut(found.where(F.col("doc_id").isNotNull()).select("own", F.col("doc_id").alias("node"), "component_id").distinct())
    members = found.select(F.col("component_id").alias("u"), F.struct("own", "node").alias("v"))
    least = members.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")).where("degree > 1")
    # a large component's least goes to its documents
    gone = with_least(members, least, max(1, 2 * found.count() // HUBS)).where("v != m").select(F.col("v.own").alias("doc_id"), "v.node")
    named = docs.select(*COLUMNS, node).where(F.col("doc_id").isNotNull()).join(gone, ["doc_id", "node"], "left_anti").dropDuplicates(["doc_id", "node"])
    return named.select(*COLUMNS).unionByName(docs.select(*COLUMNS).where(F.col("doc_id").isNull()))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 50 bytes that earlier documents have; documents of which nothing is left go."""
    out = suffix_dedup(docs.select(*COLUMNS), kept=True, columns=["lang", "source"])
    left = out.where((F.col("n_removed") == 0) | (F.length("kept") > 0)).withColumnRenamed("kept", "text")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, each shard of the mix in one part and shuffled there.

    The mix works on keys, two hashes of the row; equal rows share what their keys are drawn.
    """
    keys = ["__k1", "__k2"]
    named = docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias(keys[0]), F.xxhash64(F.lit(1), *COLUMNS).alias(keys[1]))
    out = mixed(named, carry=keys).where("copies > 0")
    drawn = cut(out.select("__row.*", "place", F.explode("shards").alias("shard")))
    texts = named.dropDuplicates(keys).join(drawn, keys)
    shards = max(1, drawn.select("shard").distinct().count())
    return texts.repartition(shards, "shard").sortWithinPartitions("shard", "place").select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences."""
    return pack(docs.select("doc_id", "text"), vocabulary())


STAGES = [("quality_classifier", classify), ("minhash_near_dedup", one_of_each), ("suffix_array_dedup", without_repeats), ("source_mixing", mix), ("packing", sequences)]

#: Packing, the draw of blocks and the model's thresholds have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; a stage's table goes when the next one's is written, only the last that is read stays."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        path = written(stage(spark, docs, sf_dir))
        if before:
            discard(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
