"""A stored table with one row a key, in hash buckets, of which an upsert or a purge rewrites only those that it touches.

A version is a small table, the manifest, that names for each bucket the folder with its rows. A change writes the new
rows of the touched buckets to a folder of their own, then a manifest that takes the other buckets from the version
before, and last renames that to `manifest/v=<n>`, which is there whole or not at all. A reader takes the newest version
and is never disturbed by a change; if two writers make the same version, the rename of one fails, and it may try again.
A change that carries a batch number is done once: repeated, it finds its number in the manifest and writes nothing.

All access goes through Spark and Hadoop's file systems. Renames are atomic on HDFS and local disks; stores without such
renames (S3 without a committer) need one writer at a time.

Edge cases: rows without key are an error; of rows with one key the last version stays, an update wins a tie, and of
updates with one version the one that is greatest as a row; an empty table has a manifest without buckets.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "bucket int, path string, batch long, settings string"


class IndexTable:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # ---- versions

    def _files(self, path: str) -> tuple[object, object]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, path: str) -> list[str]:
        store, at = self._files(path)
        return [x.getPath().getName() for x in store.listStatus(at)] if store.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(x[2:]) for x in self._names(f"{self.folder}/manifest") if x.startswith("v="))

    def _manifest(self, version: int | None = None) -> tuple[int, dict[int, str], int, dict]:
        """Version, folders of the buckets, last batch and settings. A manifest has a row a bucket, and one without bucket."""
        version = self.versions()[-1] if version is None else version
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest/v={version}").collect()  # as many as buckets
        head = next(r for r in rows if r["bucket"] is None)
        return version, {r["bucket"]: r["path"] for r in rows if r["bucket"] is not None}, head["batch"], json.loads(head["settings"])

    def _commit(self, version: int, paths: dict[int, str], batch: int, settings: dict) -> None:
        rows = [(k, p, None, None) for k, p in paths.items()] + [(None, None, batch, json.dumps(settings))]
        made = f"{self.folder}/manifest/.made-{uuid.uuid4().hex}"
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(made)
        (store, source), (_, target) = self._files(made), self._files(f"{self.folder}/manifest/v={version}")
        if store.exists(target) or not store.rename(source, target):
            raise RuntimeError(f"version {version} was written by another; read and try again")

    # ---- reading and writing

    def _bucket(self, settings: dict) -> Column:
        return F.pmod(F.xxhash64(settings["key"]), F.lit(settings["buckets"])).cast("int")

    def _write(self, rows: DataFrame, settings: dict) -> dict[int, str]:
        """Rows to a folder of their own, a file a bucket; the folders of the buckets that have rows."""
        path = f"{self.folder}/data/{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self._bucket(settings)).repartition("_bucket").write.partitionBy("_bucket").parquet(path)
        return {int(x.partition("=")[2]): f"{path}/{x}" for x in self._names(path) if x.startswith("_bucket=")}

    def _read(self, paths: list[str], settings: dict) -> DataFrame:
        schema = T.StructType.fromJson(settings["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @classmethod
    def create(cls, df: DataFrame, folder: str, key: str, version: str, buckets: int = 64) -> IndexTable:
        """A new table of the last version of each key. Choose the buckets so that one fits a task: they are rewritten whole."""
        table = cls(df.sparkSession, folder)
        settings = {"key": key, "version": version, "buckets": buckets, "schema": df.schema.jsonValue()}
        table._commit(0, table._write(_last(df.withColumn("_update", F.lit(0)), key, version), settings), -1, settings)
        return table

    def read(self, version: int | None = None) -> DataFrame:
        _, paths, _, settings = self._manifest(version)
        return self._read(list(paths.values()), settings)

    def upsert(self, updates: DataFrame, batch: int | None = None) -> list[int]:
        """Replaces rows by key, last version first; returns the buckets that were rewritten."""
        version, paths, done, settings = self._manifest()
        if batch is not None and batch <= done:
            return []
        columns = T.StructType.fromJson(settings["schema"]).fieldNames()
        new = updates.select(*columns).withColumn("_update", F.lit(1)).withColumn(settings["key"], F.when(F.col(settings["key"]).isNull(), F.raise_error(F.lit("a row has no key"))).otherwise(F.col(settings["key"])))
        touched = sorted(r[0] for r in new.select(self._bucket(settings)).distinct().collect())  # at most the buckets
        old = self._read([paths[k] for k in touched if k in paths], settings).withColumn("_update", F.lit(0))
        made = self._write(_last(old.unionByName(new), settings["key"], settings["version"]), settings) if touched else {}
        self._commit(version + 1, paths | made, done if batch is None else batch, settings)
        return touched

    def delete_where(self, predicate: Column, batch: int | None = None) -> list[int]:
        """Purges the rows for which the predicate holds; returns the buckets that were rewritten, those with such rows."""
        version, paths, done, settings = self._manifest()
        if batch is not None and batch <= done:
            return []
        hit = F.coalesce(predicate, F.lit(False))
        touched = sorted(r[0] for r in self._read(list(paths.values()), settings).filter(hit).select(self._bucket(settings)).distinct().collect())
        made = self._write(self._read([paths[k] for k in touched], settings).filter(~hit), settings) if touched else {}
        self._commit(version + 1, {k: p for k, p in paths.items() if k not in touched} | made, done if batch is None else batch, settings)
        return touched

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes all versions but the last `keep`, and folders of rows that no version left names; what a reader of an
        older version still reads, and what a writer has not committed yet, is lost."""
        versions = self.versions()
        for v in versions[:-keep]:
            store, at = self._files(f"{self.folder}/manifest/v={v}")
            store.delete(at, True)
        used = {p for v in versions[-keep:] for p in self._manifest(v)[1].values()}
        gone = []
        for x in self._names(f"{self.folder}/data"):
            whole = f"{self.folder}/data/{x}"
            buckets = [f"{whole}/{y}" for y in self._names(whole) if y.startswith("_bucket=")]
            gone += [p for p in buckets if p not in used] if used & set(buckets) else [whole]
        for path in gone:
            store, at = self._files(path)
            store.delete(at, True)
        return gone


def _last(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The last version of each key, by a partial aggregate: hot keys are thinned before the shuffle."""
    columns = [c for c in rows.columns if c != "_update"]
    best = F.max(F.struct(F.col(version).alias("v"), "_update", F.struct(*columns).alias("row")))
    return rows.groupBy(F.col(key).alias("_key")).agg(best.alias("m")).select("m.row.*")
