"""Bucketed tables that a stream keeps up: parts by batch, compacted, named by a manifest.

Rows live in buckets of their key. A batch adds one part with the buckets it touches; a
bucket with more than ``PARTS`` parts is rewritten as one. The manifest of a batch (one row
per kind and bucket) names the parts that count, so readers open the buckets they need and
never list or read the rest. Parts and manifests carry the batch id and are written whole:
a batch that is replayed replaces its own and reads only what earlier ones named.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
PARTS = 8
MANIFEST = "kind string, bucket int, parts array<string>"


class Store:
    """The tables of one streaming job under ``folder``: kind to schema."""

    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, T.StructType], key: str,
                 buckets: int = BUCKETS, most: int = PARTS):
        self.spark, self.folder, self.schemas, self.key, self.buckets, self.most = spark, folder, schemas, key, buckets, most

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def parts(self, batch_id: int) -> dict[tuple[str, int], list[str]]:
        """What counts after a batch, nothing before the first: at most kinds x buckets rows."""
        if batch_id < 0:
            return {}
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest/{batch_id}").collect()
        return {(r.kind, r.bucket): list(r.parts) for r in rows}

    def read(self, kind: str, parts: dict[tuple[str, int], list[str]], buckets: set[int] | None = None) -> DataFrame:
        """The stored rows of the buckets, each with its ``batch``."""
        schema = T.StructType([*self.schemas[kind].fields, T.StructField("batch", T.LongType())])
        paths = [f"{self.folder}/{p}/bucket={b}" for (k, b), held in sorted(parts.items()) if k == kind and (buckets is None or b in buckets)
                 for p in held]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def add(self, kind: str, rows: DataFrame, batch_id: int, parts: dict) -> set[int]:
        """Write a batch's rows as a part and name it; the buckets it touched."""
        part = f"{kind}/v{batch_id}"
        self._write(rows.withColumn("batch", F.lit(batch_id).cast("long")), part)
        touched = {r.bucket for r in self.spark.read.parquet(f"{self.folder}/{part}").select("bucket").distinct().collect()} if self._filled(part) else set()
        for b in touched:
            parts[kind, b] = [*parts.get((kind, b), []), part]
        return touched

    def compact(self, kind: str, batch_id: int, parts: dict, newest: Callable[[DataFrame], DataFrame]) -> None:
        """Rewrite the buckets of a kind that have too many parts; ``newest`` keeps the rows that still count."""
        full = {b for (k, b), held in parts.items() if k == kind and len(held) > self.most}
        if full:
            part = f"{kind}/s{batch_id}"
            self._write(newest(self.read(kind, parts, full)), part)
            for b in full:
                parts[kind, b] = [part]

    def close(self, batch_id: int, parts: dict) -> None:
        rows = [(k, b, held) for (k, b), held in parts.items()]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/{batch_id}")

    def newest_manifest(self) -> int:
        """The last closed batch, -1 if there is none."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return -1
        closed = [int(s.getPath().getName()) for s in fs.listStatus(path) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return max(closed, default=-1)

    def _write(self, rows: DataFrame, part: str) -> None:
        """One file for each bucket."""
        placed = rows.withColumn("bucket", self.bucket())
        placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{part}")

    def _filled(self, part: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{part}")
        return any("bucket=" in s.getPath().getName() for s in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path))
