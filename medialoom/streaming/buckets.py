"""A table of current rows kept as key buckets: a base, deltas on top, merged when read, compacted bucket by bucket."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass
class BucketTable:
    """Current rows by ``key`` below ``path``: of several versions the last by ``order``, created at the earliest time.

    A batch is written as a delta, parted by the buckets of its keys, so writing costs what the batch holds. Reading
    merges each bucket's base with the deltas that aren't in it yet. ``compact`` rewrites only buckets whose deltas have
    ``least_rows`` rows, as a new generation of these buckets, and then names the new generations in a manifest, which is
    what readers go by: one that reads meanwhile still finds the old files until ``clean`` removes them.

    A batch that is written again replaces its delta, and if a bucket has taken it in already it doesn't count again.
    """

    spark: SparkSession
    path: str
    schema: StructType
    key: list[str]
    order: list[str]
    created: str
    buckets: int = 64
    least_rows: int = 1
    full: StructType = field(init=False)

    def __post_init__(self) -> None:
        made = self.schema[self.created].dataType
        self.full = StructType([*self.schema.fields]).add("created_at", made)

    def of(self, *parts: str) -> str:
        return os.path.join(self.path, *parts)

    def files(self, pattern: str) -> list[str]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().toString() for s in fs.globStatus(hadoop.Path(root, pattern)) or []]

    def drop(self, folders: list[str]) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        for folder in folders:
            at = hadoop.Path(folder)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def numbers(self, pattern: str) -> list[int]:
        """Numbers that end the names of what matches, such as batches; a handful or one per batch."""
        return sorted(int(f.rstrip("/").split("=")[-1]) for f in self.files(pattern))

    def manifest(self) -> dict[int, tuple[int, int]]:
        """Per bucket the generation of its base and the last batch in it: at most one row a bucket."""
        done = [int(f.split("version=")[1].split("/")[0]) for f in self.files("manifest/version=*/_SUCCESS")]
        if not done:
            return {}
        rows = self.spark.read.schema("bucket int, generation int, batch bigint").parquet(self.of("manifest", f"version={max(done)}"))
        return {r["bucket"]: (r["generation"], r["batch"]) for r in rows.collect()}

    def reduced(self, rows: DataFrame) -> DataFrame:
        """One row per key, combined before the shuffle."""
        rest = [c for c in self.schema.names if c not in self.key]
        per = rows.groupBy(*self.key).agg(F.max_by(F.struct(*rest), F.struct(*self.order)).alias("_row"), F.min("created_at").alias("created_at"))
        return per.select(*self.key, *[F.col(f"_row.{c}").alias(c) for c in rest], "created_at").select(*self.full.names)

    def bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))

    def write(self, batch: DataFrame, batch_id: int) -> None:
        rows = self.bucketed(self.reduced(batch.select(*self.schema.names).withColumn("created_at", F.col(self.created))))
        rows.write.mode("overwrite").partitionBy("bucket").parquet(self.of("delta", f"batch_id={batch_id}"))

    def deltas(self, manifest: dict[int, tuple[int, int]]) -> DataFrame:
        """Delta rows that are in no base yet, with their bucket and batch."""
        schema = StructType([*self.full.fields]).add("batch_id", "long").add("bucket", "integer")
        if not self.files("delta/batch_id=*"):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", self.of("delta")).parquet(self.of("delta"))
        if not manifest:
            return rows
        taken = F.array(*[F.lit(manifest.get(b, (0, -1))[1]).cast("bigint") for b in range(self.buckets)])
        return rows.filter(F.col("batch_id") > F.get(taken, F.col("bucket")))

    def base(self, manifest: dict[int, tuple[int, int]], buckets: set[int] | None = None) -> DataFrame:
        folders = [self.of("base", f"generation={g}", f"bucket={b}") for b, (g, _) in sorted(manifest.items()) if buckets is None or b in buckets]
        if not folders:
            return self.spark.createDataFrame([], self.full)
        return self.spark.read.schema(self.full).parquet(*folders)

    def read(self) -> DataFrame:
        manifest = self.manifest()
        deltas = self.deltas(manifest).drop("batch_id", "bucket")
        return self.reduced(self.base(manifest).unionByName(deltas))

    def compact(self) -> list[int]:
        """Take the waiting deltas into the bases of the buckets that have enough of them; returns those buckets."""
        manifest = self.manifest()
        waiting = self.deltas(manifest)
        per = waiting.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("batch_id").alias("batch"))
        chosen = {r["bucket"]: r["batch"] for r in per.filter(F.col("n") >= self.least_rows).collect()}
        if not chosen:
            return []
        generation = max(self.numbers("base/generation=*"), default=0) + 1
        limit = F.array(*[F.lit(chosen.get(b, -1)).cast("bigint") for b in range(self.buckets)])
        fresh = waiting.filter(F.col("batch_id") <= F.get(limit, F.col("bucket"))).drop("batch_id", "bucket")
        merged = self.bucketed(self.reduced(self.base(manifest, set(chosen)).unionByName(fresh)))
        merged.write.mode("overwrite").partitionBy("bucket").parquet(self.of("base", f"generation={generation}"))
        manifest |= {b: (generation, batch) for b, batch in chosen.items()}
        version = max(self.numbers("manifest/version=*"), default=0) + 1
        rows = [(b, g, n) for b, (g, n) in sorted(manifest.items())]
        named = self.spark.createDataFrame(rows, "bucket int, generation int, batch bigint").coalesce(1)
        named.write.mode("overwrite").parquet(self.of("manifest", f"version={version}"))
        return sorted(chosen)

    def clean(self) -> int:
        """Remove bases that the manifest no longer names and deltas that are in every bucket they touch."""
        manifest = self.manifest()
        named = {(g, b) for b, (g, _) in manifest.items()}
        place = lambda f: tuple(int(part.split("=")[1]) for part in f.rstrip("/").split("/")[-2:])
        old = [f for f in self.files("base/generation=*/bucket=*") if place(f) not in named]
        old += [f for f in self.files("delta/batch_id=*/bucket=*") if place(f)[0] <= manifest.get(place(f)[1], (0, -1))[1]]
        self.drop(old)
        return len(old)
