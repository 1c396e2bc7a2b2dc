"""State that outlives a job: keyed tables of versions, upserted by key, switched at once.

A table is a folder of versions. A version is a small file that names, for each bucket of keys, the folder
with its rows, and the last batch of each stream that went into it. An upsert writes the buckets it touches
anew, beside the old ones, and then the version; until that one file is there readers see the version before,
and a job that dies leaves only folders that nobody names (``vacuum`` removes them). A batch that
went in already changes nothing when it comes again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..scratch import written


class StateTable:
    """Rows by ``key``, dealt to buckets by ``by`` (some of the key, all of it unless told)."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], by: list[str] | None = None, buckets: int = 16):
        self.spark, self.path, self.key, self.by, self.buckets = spark, path.rstrip("/"), key, by or key, buckets
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._files = self._place("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _place(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        """All versions that are there, the oldest first."""
        folder = self._place("versions")
        if not self._files.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._files.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known:
            return {"version": 0, "schema": None, "buckets": {}, "batches": {}}
        path = f"{self.path}/versions/{known[-1] if version is None else version}"
        return json.loads(self.spark.read.text(path, wholetext=True).first()[0])

    def _commit(self, manifest: dict) -> None:
        final, draft = self._place(f"versions/{manifest['version']}"), self._place(f"versions/.{uuid.uuid4().hex}")
        out = self._files.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._files.exists(final) or not self._files.rename(draft, final):
            self._files.delete(draft, False)
            raise RuntimeError(f"another writer made version {manifest['version']} of {self.path}")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame | None:
        """The rows of a version (the last), of all buckets or some; null while there is none."""
        manifest = self.manifest(version)
        if manifest["schema"] is None:
            return None
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        paths = [f"{self.path}/{place}" for b, place in manifest["buckets"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that hold the rows' keys; there are at most ``buckets``."""
        return [r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect()]

    def upsert(self, rows: DataFrame, order: list[str] = (), batch: tuple[str, int] | None = None, keep: Column | None = None, newest: tuple[list[str], list[Column], int] | None = None) -> int:
        """Puts rows in by key and returns the version: of rows of one key the greatest by ``order``, then the one that came last.

        batch: stream and number, which go in once. keep: what a row must fulfil to stay. newest: (by, order,
        n): of each group, which must hold the bucket's columns, the first n stay.
        """
        manifest = self.manifest()
        if batch is not None and manifest["batches"].get(batch[0], -1) >= batch[1]:
            return manifest["version"]
        rows = written(rows, "upsert")  # read for its buckets, then for itself
        only = self.touched(rows)
        if only or manifest["schema"] is None:
            old = self.read(only=only)
            columns = rows.columns
            both = rows.withColumn("came_", F.lit(1)) if old is None else rows.withColumn("came_", F.lit(1)).unionByName(old.select(*columns).withColumn("came_", F.lit(0)))
            rest = [c for c in columns if c not in self.key]
            last = F.max_by(F.struct(*rest, F.lit(0).alias("came_")), F.struct(*order, "came_"))
            merged = both.groupBy(*self.key).agg(last.alias("row_")).select(*[F.col(c) if c in self.key else F.col(f"row_.{c}") for c in columns])
            merged = merged if keep is None else merged.where(keep)
            if newest is not None:
                group, rank, n = newest
                merged = merged.withColumn("rank_", F.row_number().over(Window.partitionBy(*group).orderBy(*rank))).where(F.col("rank_") <= n).drop("rank_")
            place = f"data/{uuid.uuid4().hex}"
            merged.withColumn("bucket_", self.bucket()).repartition("bucket_").write.partitionBy("bucket_").parquet(f"{self.path}/{place}")
            manifest["schema"] = rows.schema.json()
            for b in only:
                manifest["buckets"].pop(str(b), None)
                if self._files.exists(self._place(f"{place}/bucket_={b}")):
                    manifest["buckets"][str(b)] = f"{place}/bucket_={b}"
        if batch is not None:
            manifest["batches"][batch[0]] = batch[1]
        manifest["version"] += 1
        self._commit(manifest)
        return manifest["version"]

    def vacuum(self, versions: int = 2) -> int:
        """Removes all versions but the last few and the folders that none of these names; how many folders went."""
        known = self.versions()
        kept = {place.split("/bucket_=")[0] for v in known[-versions:] for place in self.manifest(v)["buckets"].values()}
        for v in known[:-versions]:
            self._files.delete(self._place(f"versions/{v}"), False)
        folder = self._place("data")
        gone = [f.getPath() for f in self._files.listStatus(folder) if f"data/{f.getPath().getName()}" not in kept] if self._files.exists(folder) else []
        for place in gone:
            self._files.delete(place, True)
        return len(gone)
