"""A versioned catalog that publishes only what changed.

The catalog is dealt into `partitions` by a hash of `sku_key`.  A version is a manifest that names,
for each partition, the version that wrote it last:

    <root>/data/v=<n>/part=<k>/...     rows of partition k as version n wrote them
    <root>/manifest/v=<n>/...          part, v, rows, max_id

A feed touches the partitions of its keys: only these are read, merged and written, and the
next manifest carries the others over.  The manifest's `_SUCCESS` publishes the version, so a
version is whole or absent, and writing it again (a replayed micro-batch) gives the same one.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedyard import schemas as S
from feedyard.operators import merge
from feedyard.session import path_exists


class PartitionedCatalog:
    """partitions: as many as make one a task's work (some hundred MB); fixed for a catalog."""

    def __init__(self, spark: SparkSession, root: str, partitions: int = 256):
        self.spark, self.root, self.partitions = spark, root.rstrip("/"), partitions

    # ---- paths -------------------------------------------------------------------------

    def _data(self, version: int) -> str:
        return f"{self.root}/data/v={version:09d}"

    def _manifest(self, version: int) -> str:
        return f"{self.root}/manifest/v={version:09d}"

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        p, fs = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    # ---- reading -----------------------------------------------------------------------

    def versions(self) -> list[int]:
        return [int(n[2:]) for n in self._names(f"{self.root}/manifest") if n.startswith("v=") and path_exists(self.spark, f"{self.root}/manifest/{n}/_SUCCESS")]

    def current_version(self) -> int | None:
        return max(self.versions(), default=None)

    def _held(self, version: int) -> list:
        """A manifest: at most `partitions` rows."""
        return self.spark.read.parquet(self._manifest(version)).collect()

    def read(self, version: int | None = None, parts: list[int] | None = None) -> DataFrame:
        """The catalog, or some of its partitions."""
        v = self.current_version() if version is None else version
        if v is None:
            raise FileNotFoundError(f"no published catalog under {self.root}")
        paths = [f"{self._data(r['v'])}/part={r['part']}" for r in self._held(v) if parts is None or r["part"] in set(parts)]
        if not paths:
            return self.spark.createDataFrame([], S.CATALOG)
        return self.spark.read.schema(S.CATALOG).parquet(*paths)

    def part_of(self, key: str = "sku_key"):
        return F.pmod(F.xxhash64(key), F.lit(self.partitions)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """Partitions that hold the keys of `rows`: at most `partitions` numbers."""
        return sorted(r["part"] for r in rows.select(self.part_of().alias("part")).distinct().collect())

    # ---- publishing -----------------------------------------------------------------------

    def publish(self, df: DataFrame, version: int) -> int:
        """The whole catalog as a version."""
        return self._write(df, version, [])

    def publish_parts(self, df: DataFrame, version: int, base: int, parts: list[int]) -> int:
        """`df` replaces the partitions `parts` of version `base`; the others are carried over."""
        return self._write(df if parts else None, version, [r for r in self._held(base) if r["part"] not in set(parts)])

    def _write(self, df: DataFrame | None, version: int, carried: list) -> int:
        kind = "part int, v long, rows long, max_id long"
        lines = self.spark.createDataFrame([tuple(r[c] for c in ("part", "v", "rows", "max_id")) for r in carried], kind)
        if df is not None:
            out = df.select(*[f.name for f in S.CATALOG]).withColumn("part", self.part_of())
            out.repartition("part").sortWithinPartitions("part", "sku_key").write.mode("overwrite").partitionBy("part").parquet(self._data(version))
            own = self.spark.read.schema("id long, part int").parquet(self._data(version)).groupBy("part").agg(F.count("*").alias("rows"), F.max("id").alias("max_id"))
            lines = lines.unionByName(own.withColumn("v", F.lit(version).cast("long")))
        lines.coalesce(1).write.mode("overwrite").parquet(self._manifest(version))
        return version

    def upsert(self, acc: DataFrame, run_ts, base: int, version: int) -> list[int]:
        """D2 on the touched partitions of version `base`, published as `version`; returns them."""
        parts = self.touched(acc)
        top = max((r["max_id"] for r in self._held(base)), default=0)
        merged = merge.upsert(self.read(base, parts), acc, run_ts, max_id=top) if parts else None
        self.publish_parts(merged, version, base, parts)
        return parts

    def drop_before(self, version: int) -> None:
        """Delete the versions under `version`, and the data that no later one names."""
        kept = [v for v in self.versions() if v >= version]
        named = {(r["v"], r["part"]) for v in kept for r in self._held(v)}
        for v in self.versions():
            if v < version:
                self._delete(self._manifest(v))
        for n in self._names(f"{self.root}/data"):
            v = int(n[2:])
            parts = [p for p in self._names(f"{self.root}/data/{n}") if p.startswith("part=")]
            gone = [p for p in parts if v < version and (v, int(p[5:])) not in named]
            for path in [n] if parts and len(gone) == len(parts) else [f"{n}/{p}" for p in gone]:
                self._delete(f"{self.root}/data/{path}")

    def _delete(self, path: str) -> None:
        p, fs = self._fs(path)
        fs.delete(p, True)
