"""Questions that blocks of documents ask of sharded tables, in rounds.

A hash of the document deals the rows to blocks of bounded size.  In each round a
block sends every shard one packed message with its different keys (so a key that
a third of all rows hold arrives once a block, not once a row), the shard merges
what it got, and its answers come back to the block.  Rows of text are shuffled
once: every round reads the same exchange.  All of it is one lazy plan of
grouped Arrow functions, so lost executors cost their tasks only.

The number of messages is blocks times shards.  So both sizes grow with the square
root of the input, as far as a task's memory goes (`sized`), and shuffles have as
many partitions as the input needs, whatever the session's number is.

Rows are dealt to blocks by a hash of id and text, moved on by the task that reads
them and by how many equal rows it had before: no id or text fills a block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import U, release

#: Bytes of documents for each shuffle partition.
PARTITION_BYTES = 64 << 20
#: The column of a row's block.
BLOCK = "__block"
MESSAGE = "block int, shard int, body binary"
#: Rows with this flag in `shard` go through a shard unread and return to their block.
STATE = 1 << 30

Messages = dict[int, bytes]


def table_bytes(df: DataFrame) -> int:
    """Spark's estimate of the table's size; counted where there is none."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= 1 << 50:
        size = int(df.select(F.sum(F.octet_length("text"))).first()[0] or 0)
    return size


def task_memory(spark: SparkSession) -> int:
    """Bytes of heap that a task has."""
    conf, local = spark.sparkContext.getConf(), spark.sparkContext.master.startswith("local")
    memory = conf.get("spark.driver.memory" if local else "spark.executor.memory", "1g")
    cores = spark.sparkContext.defaultParallelism if local else int(conf.get("spark.executor.cores", "1")) // int(conf.get("spark.task.cpus", "1"))
    return int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(memory)) // max(1, cores)


def sized(docs: DataFrame, least: int) -> int:
    """Bytes of a block or shard: `least`, or more for large tables if a task's memory holds some hundred times as much."""
    return max(least, min(math.isqrt(table_bytes(docs) * 4096), task_memory(docs.sparkSession) // 400))


def blocked(docs: DataFrame, columns: list[str], block_bytes: int = 3 << 19, least: int = 64) -> tuple[DataFrame, int]:
    """docs with `block` from doc_id and text, and how many blocks there are; each text is compressed for the shuffle."""
    n = max(least, math.ceil(table_bytes(docs) / block_bytes))
    block = F.xxhash64("doc_id", "text").alias("__block")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *columns)

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, task, seen = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId(), {}
        for b in batches:
            blocks = []
            for h in b.column(0).to_pylist():
                k = seen[h] = seen.get(h, 0) + 1
                blocks.append((h + 40503 * task + k // 16) % n)
            if len(seen) > 1 << 18:
                seen.clear()
            texts = [None if t is None else z.compress(t) for t in b.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), b.column(1), pa.array(texts, pa.binary()), *b.columns[3:]], names=[BLOCK, "doc_id", "text", *columns])
        release()

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"{BLOCK} int, doc_id long, text binary", *(f"`{c}` {kinds[c]}" for c in columns)])
    return named.select(block, "doc_id", "text", *columns).mapInArrow(shrink, schema), n


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed message; their bytes lie in planes, so that small numbers cost little."""
    parts = [len(arrays).to_bytes(1, "little")]
    for a in arrays:
        parts.append(len(a).to_bytes(8, "little") + a.dtype.str.encode().ljust(4) + np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else (0).to_bytes(8, "little") + a.dtype.str.encode().ljust(4))
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def expand(body: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    out, at = [], 1
    for _ in range(raw[0]):
        n, kind = int.from_bytes(raw[at : at + 8], "little"), np.dtype(raw[at + 8 : at + 12].decode().strip())
        at += 12
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind) if n else np.empty(0, kind))
        at += n * kind.itemsize
    return out


def deltas(ascending: np.ndarray) -> np.ndarray:
    """Differences of an ascending array, in a type as narrow as they allow."""
    d = np.diff(ascending.astype(np.uint64), prepend=U(0))
    for kind in (np.uint8, np.uint16, np.uint32):
        if not len(d) or d.max() <= np.iinfo(kind).max:
            return d.astype(kind)
    return d


def narrow(values: np.ndarray) -> np.ndarray:
    """Numbers from 0 in a type as narrow as they allow."""
    most = int(values.max()) if len(values) else 0
    return values.astype(next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(k).max))


def sums(d: np.ndarray) -> np.ndarray:
    return np.cumsum(d.astype(np.uint64), dtype=np.uint64)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards by the highest bits, so that the shards of sorted hashes are runs."""
    return ((hashes >> U(32)) * U(shards) >> U(32)).astype(np.int64)


def shard_runs(ascending: np.ndarray, shards: int) -> list[tuple[int, int, int]]:
    """(shard, start, stop) of the shards that have some of the ascending hashes."""
    s = shard_of(ascending, shards)
    edges = np.flatnonzero(np.diff(s, prepend=-1, append=-2)) if len(s) else np.empty(0, np.int64)
    return [(int(s[i]), int(i), int(j)) for i, j in zip(edges[:-1], edges[1:], strict=True)]


def _column(table: pa.Table, name: str) -> list:
    return table[name].to_pylist()


def _send(block: int, messages: Iterable[tuple[int, bytes]]) -> pa.Table:
    rows = list(messages)
    return pa.table({"block": pa.array([block] * len(rows), pa.int32()), "shard": pa.array([s for s, _ in rows], pa.int32()), "body": pa.array([b for _, b in rows], pa.binary())})


class Exchange:
    """Rounds of questions.  ask(table, answers, state) gives (shard, message) pairs, where shard None is the block's
    own state for the next round; reduce(messages by block) gives answers by block."""

    def __init__(self, blocks: DataFrame, shards: int, size: int = 0):
        """size: bytes of the documents, from which the number of shuffle partitions follows where the session has fewer."""
        want = math.ceil(size / PARTITION_BYTES)
        self.parts = want if want > int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None
        self.blocks, self.shards, self.answers = self.dealt(blocks, BLOCK), shards, None

    def dealt(self, df: DataFrame, key: str) -> DataFrame:
        return df.repartition(self.parts, key) if self.parts else df

    def round(self, ask: Callable, reduce: Callable, table: DataFrame | None = None, with_texts: bool = True) -> None:
        """with_texts: blocks see their rows again, else they ask from their state and answers only.  table: rows with a column `shard` that meet the shard's messages; reduce then gets them as a second argument."""
        shards = self.shards

        def alone(back: pa.Table) -> pa.Table:
            answers, state = received(back)
            block = back["block"][0].as_py()
            sent = _send(block, [((block % shards) | STATE if s is None else s, b) for s, b in ask(None, answers, state)])
            release()
            return sent

        def addressed(table: pa.Table, back: pa.Table | None) -> pa.Table:
            if not table.num_rows:
                return _send(0, [])
            block = table[BLOCK][0].as_py()
            table = in_order(table)
            answers, state = received(back)
            sent = _send(block, [((block % shards) | STATE if s is None else s, b) for s, b in ask(table, answers, state)])
            release()
            return sent

        def reduced(table: pa.Table, rows: pa.Table | None = None) -> pa.Table:
            if not table.num_rows:
                return _send(0, [])
            shard, blocks, bodies = table["shard"][0].as_py(), _column(table, "block"), _column(table, "body")
            if shard & STATE:
                return table.select(["block", "shard", "body"])
            messages = list(zip(blocks, bodies, strict=True))
            out = list(reduce(messages) if rows is None else reduce(messages, rows))
            release()
            return pa.table({"block": pa.array([b for b, _ in out], pa.int32()), "shard": pa.array([shard] * len(out), pa.int32()), "body": pa.array([b for _, b in out], pa.binary())})

        if self.answers is None:
            sent = self.blocks.groupBy(BLOCK).applyInArrow(lambda table: addressed(table, None), MESSAGE)
        elif not with_texts:
            sent = self.dealt(self.answers, "block").groupBy("block").applyInArrow(lambda back: alone(back), MESSAGE)
        else:
            sent = self.blocks.groupBy(BLOCK).cogroup(self.dealt(self.answers, "block").groupBy("block")).applyInArrow(addressed, MESSAGE)
        own = self.dealt(sent, "shard").groupBy("shard")
        if table is None:
            self.answers = own.applyInArrow(lambda t: reduced(t), MESSAGE)
        else:
            self.answers = own.cogroup(self.dealt(table, "shard").groupBy("shard")).applyInArrow(lambda t, rows: reduced(t, rows), MESSAGE)

    def finish(self, last: Callable, schema: str) -> DataFrame:
        """last(table, answers, state) gives a table of the schema for each block."""
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()

        def ended(table: pa.Table, back: pa.Table) -> pa.Table:
            if not table.num_rows:
                return empty
            answers, state = received(back)
            out = last(in_order(table), answers, state)
            release()
            return out

        return self.blocks.groupBy(BLOCK).cogroup(self.dealt(self.answers, "block").groupBy("block")).applyInArrow(ended, schema)


def in_order(table: pa.Table) -> pa.Table:
    """A block's rows in the same order in each round, whatever order they arrived in, their texts as bytes again."""
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    z = zstandard.ZstdDecompressor()
    texts = [None if t is None else z.decompress(t) for t in table["text"].to_pylist()]
    return table.set_column(table.schema.get_field_index("text"), "text", pa.array(texts, pa.binary()))


def received(back: pa.Table | None) -> tuple[Messages, bytes | None]:
    """(answers by shard, the block's state)."""
    if back is None:
        return {}, None
    rows = dict(zip(_column(back, "shard"), _column(back, "body"), strict=True))
    state = next((b for s, b in rows.items() if s & STATE), None)
    return {s: b for s, b in rows.items() if not s & STATE}, state
