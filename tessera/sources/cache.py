"""Header and tile caches as tables.

Headers live in a Parquet table keyed by path and version (length and time of
change); a file whose version differs is read again, and only those.  Decoded
tiles are a persisted DataFrame: Spark evicts, spills and recomputes it.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cog import from_files


@dataclass
class HeaderCache:
    """Raster headers under `folder`.  validation: "match" compares versions each time, "ttl" trusts for `ttl` seconds, "immutable" for ever."""

    spark: SparkSession
    folder: str
    validation: str = "match"
    ttl: float = 3600.0
    checked: dict[str, float] = field(default_factory=dict)
    hits: int = 0
    misses: int = 0

    def known(self) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        latest = self.spark.read.parquet(self.folder)
        return latest.groupBy("path").agg(F.max_by(F.struct(*[c for c in latest.columns if c not in ("path", "at")]), "at").alias("r")).select("path", "r.*")

    def headers(self, files: DataFrame) -> DataFrame:
        """The headers of files (as `binaryFile` has them): those known and unchanged from the table, the others read and kept."""
        known = self.known()
        key = F.concat_ws(":", "length", F.unix_micros("modificationTime"))
        trusted = self.validation == "immutable" or (self.validation == "ttl" and time.time() - self.checked.get(self.folder, 0) < self.ttl)
        stamped = files.withColumn("__version", key)
        if known is None:
            fresh = stamped
        else:
            same = (stamped["path"] == known["path"]) if trusted else (stamped["path"] == known["path"]) & (stamped["__version"] == known["version"])
            fresh = stamped.join(known, same, "left_anti")
        read = from_files(fresh.drop("__version"), "rasters").withColumn("at", F.lit(time.time_ns()))
        before = known.count() if known is not None else 0
        read.write.mode("append").parquet(self.folder)
        self.checked[self.folder] = time.time()
        now = self.known()
        out = now.join(stamped.select("path").distinct(), "path", "left_semi")
        added = self.spark.read.parquet(self.folder).where(F.col("at") >= 0).count() - before
        self.misses += max(0, added)
        self.hits += max(0, out.count() - max(0, added))
        return out

    def invalidate(self, path: str) -> None:
        """Forget one path."""
        known = self.known()
        if known is not None:
            # written beside the table and then moved over it, as a table cannot be read and overwritten at once
            rest = known.where(F.col("path") != path).withColumn("at", F.lit(time.time_ns()))
            beside = f"{self.folder}.{time.time_ns()}"
            rest.write.parquet(beside)
            self.clear()
            new, old = (self.spark._jvm.org.apache.hadoop.fs.Path(p) for p in (beside, self.folder))
            new.getFileSystem(self.spark._jsc.hadoopConfiguration()).rename(new, old)

    def clear(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def stats(self) -> dict[str, int]:
        known = self.known()
        return {"entries": known.count() if known is not None else 0, "hits": self.hits, "misses": self.misses}


class TileCache:
    """Decoded tiles by source, persisted until they are invalidated."""

    def __init__(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK):
        self.level, self.held = level, {}

    def get(self, key: str, make) -> DataFrame:
        if key not in self.held:
            self.held[key] = make().persist(self.level)
        return self.held[key]

    def contains(self, key: str) -> bool:
        return key in self.held

    def invalidate(self, key: str) -> None:
        held = self.held.pop(key, None)
        if held is not None:
            held.unpersist()

    def clear(self) -> None:
        for key in list(self.held):
            self.invalidate(key)

    def stats(self) -> dict[str, int]:
        return {"entries": len(self.held)}
