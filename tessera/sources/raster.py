"""A raster file as one object: open it, choose levels, extract, sample, reproject.

Opening reads the header on the driver, by ranges of whatever file system Spark
has for the path; pixels are read and decoded by executors, and only the tiles
that a request needs.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import crs
from tessera.functions.geo import Level
from tessera.operators import kernel, levels, reproject, sample, stats
from tessera.operators.kernel import Request

from . import cog, tiff


class SourceChanged(RuntimeError):
    """The file is no longer the one whose header was read."""


class SourceNotFound(FileNotFoundError):
    """There is no such file."""


class HadoopRanges:
    """Ranges of a file of any store that Spark's Hadoop file systems reach, read on the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        where = self.jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(where):
            raise SourceNotFound(path)
        status = fs.getFileStatus(where)
        self.size, self.version = status.getLen(), f"{status.getLen()}:{status.getModificationTime()}"
        self.stream = fs.open(where)
        self.prefix = b""
        self.prefix = self(0, min(cog.PREFIX_BYTES, self.size))

    def __call__(self, at: int, n: int) -> bytes:
        if at + n <= len(self.prefix):
            return self.prefix[at : at + n]
        n = max(0, min(n, self.size - at))
        self.stream.seek(at)
        return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(self.stream, n)) if n else b""

    def close(self) -> None:
        self.stream.close()


def level_for(header: tiff.Header, request: Request, min_usable: int | None, source_crs: int) -> int:
    """The image to read: 0 for full resolution, k + 1 for overview k."""
    full = header.level(0)
    x, y = crs.project([request.box[0], request.box[2]], [request.box[1], request.box[3]], request.crs, source_crs)
    w, h = (int(max(1.0, abs((v[1] - v[0]) / s))) for v, s in ((x, full.scale_x), (y, full.scale_y)))
    needed = max(w, h) / levels.REFERENCE_PIXELS
    if needed < 1.5 or min_usable is None:
        return 0
    scale = lambda k: max(header.images[0].width / header.images[k].width, header.images[0].height / header.images[k].height)
    fits = [k for k in range(1, len(header.images)) if k - 1 <= min_usable and scale(k) <= needed]
    return max(fits, key=lambda k: (scale(k), -k), default=0)


#: Up to so many requests the tiles to read are worked out before the job.
PRUNED_REQUESTS = 64


@dataclass
class Raster:
    """An open raster.  hint: compute_at_runtime, all_usable, none_usable, or the index of the coarsest usable overview."""

    spark: SparkSession
    path: str
    header: tiff.Header
    version: str
    hint: str | int = "compute_at_runtime"
    local: bool = False
    _usable: dict = field(default_factory=dict, repr=False)

    @classmethod
    def open(cls, spark: SparkSession, path: str, hint: str | int = "compute_at_runtime") -> "Raster":
        local = path.startswith(("/", "file:"))
        try:
            read = cog.LocalRanges(path) if local else HadoopRanges(spark, path)
        except FileNotFoundError as e:
            raise SourceNotFound(path) from e
        try:
            return cls(spark, path, tiff.parse(read), read.version, hint, local)
        finally:
            read.close()

    def reopen(self) -> "Raster":
        return Raster.open(self.spark, self.path, self.hint)

    def check(self) -> None:
        """Raises SourceChanged if the file is another one now."""
        if self.reopen().version != self.version:
            raise SourceChanged(self.path)

    @property
    def crs(self) -> int:
        """The CRS for extraction: EPSG:3857 where the file names none."""
        return self.header.crs or 3857

    @property
    def overviews(self) -> int:
        return len(self.header.images) - 1

    def tiles(self, image: int = 0, wanted: list[int] | None = None) -> DataFrame:
        """(tile_index, pixels) of an image; wanted: only these, which alone are read."""
        if self.local:
            cog.register(self.spark)
            reader = self.spark.read.format("cog").option("what", "tiles").option("level", image)
            if wanted is not None:
                reader = reader.option("tiles", ",".join(map(str, wanted)) or "-1")
            return reader.load(self.path).select("tile_index", "pixels")
        files = self.spark.read.format("binaryFile").load(self.path)
        out = cog.from_files(files, "tiles").where(F.col("level") == image)
        return (out if wanted is None else out.where(F.col("tile_index").isin(wanted))).select("tile_index", "pixels")

    def min_usable(self) -> int | None:
        """The coarsest overview with enough data, None if none has."""
        if self.hint == "all_usable":
            return self.overviews - 1 if self.overviews else None
        if self.hint == "none_usable":
            return None
        if self.hint != "compute_at_runtime":
            return min(int(self.hint), self.overviews - 1) if self.overviews else None
        if "k" not in self._usable:
            found = None
            for k in range(self.overviews, 0, -1):
                n = len(self.header.images[k].offsets)
                probe = self.tiles(k, sorted({0, n // 2, n - 1})).withColumn("level", F.lit(k))
                if levels.quality_hint(probe).where("usable").count():
                    found = k - 1
                    break
            self._usable["k"] = found
        return self._usable["k"]

    def extract(self, requests: list[Request]) -> DataFrame:
        """Rendered output tiles; `request` is the place in the list.  Each reads its own level, and that only where needed."""
        if self.header.transform() is None:
            raise ValueError("Missing geotransform")
        by_image = defaultdict(list)
        for i, q in enumerate(requests):
            by_image[level_for(self.header, q, self.min_usable(), self.crs)].append(i)
        parts = []
        for image, own in by_image.items():
            level = self.header.level(image)
            wanted = None
            if len(own) <= PRUNED_REQUESTS:  # few requests: name the tiles to read; many read the image
                boxes = [kernel.footprint(kernel.positions(requests[i], level, self.crs), level, requests[i].method) for i in own]
                wanted = sorted({t for b in boxes if b is not None for t in kernel.tiles_of(b, level)})
            out = kernel.extract_tiles(self.spark, [requests[i] for i in own], self.tiles(image, wanted), level, self.crs)
            place = F.element_at(F.array(*[F.lit(i) for i in own]), (F.col("request") + 1).cast("int")).cast("long")
            parts.append(out.withColumn("request", place).withColumn("overview", F.lit(image - 1 if image else None).cast("int")))
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        return whole

    def reprojection(self, target_crs: int, **options) -> reproject.Reprojection:
        return reproject.plan(self.header.level(0), self.crs, target_crs, **options)

    def reproject(self, p: reproject.Reprojection) -> DataFrame:
        return self.extract([reproject.request_of(p)])

    def chunks(self, p: reproject.Reprojection, chunk: int) -> DataFrame:
        return self.extract(reproject.chunk_requests(p, chunk))

    def sample(self, points: DataFrame, point_crs: int = 4326) -> DataFrame:
        """All bands at points (x, y, ...), at full resolution."""
        return sample.sample_points(points, self.tiles(0), self.header.level(0), self.header.transform(), point_crs, self.header.crs)

    def min_max(self, fast: bool = False) -> DataFrame:
        known = (self.header.stats_min, self.header.stats_max)
        known = known if None not in known else None
        if fast:
            level: Level = self.header.level(self.overviews)
            return stats.estimate_min_max_fast(self.tiles(self.overviews, stats.fast_tiles(level.across, level.down)), level.across, level.down, self.header.nodata, known)
        return stats.estimate_min_max(self.tiles(self.overviews).withColumn("level", F.lit(0)), self.header.nodata, known)
