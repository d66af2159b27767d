"""Tables that are upserted in committed snapshots.

A table is a folder with ``data``, Parquet files by bucket of the key, and ``snapshots``, one
manifest for each version, which names its files by bucket. An upsert writes new files for the
buckets that new rows fall in, beside the old ones, and then publishes a manifest by one rename
that doesn't replace; readers see the version before or the one after. A run that fails, or an
executor that is lost, leaves files that no manifest names, and the old snapshot as it was.
Any store that Spark writes will do in which a rename is one step.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stillwave.operators import chunks as K

BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer published the version that this one was to be."""


class Snapshots:
    """A table of unique keys. ``buckets`` is fixed when it is created."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType | str, key: list[str], buckets: int = 64) -> Snapshots:
        """An empty table; one that exists is an error."""
        table = cls(spark, path)
        fields = spark.createDataFrame([], schema).schema
        if missing := set(key) - set(fields.names):
            raise ValueError(f"no columns {sorted(missing)}")
        table._publish({"version": 0, "schema": fields.jsonValue(), "key": key, "buckets": buckets, "files": {}})
        return table

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        """Published versions in order."""
        found = self._fs.globStatus(self._at("snapshots/*.json"))
        return sorted(int(f.getPath().getName().removesuffix(".json")) for f in found or [])

    def manifest(self, version: int | None = None) -> dict:
        """That of a version, or of the last one."""
        versions = self.versions()
        if not versions or version is not None and version not in versions:
            raise ValueError(f"{self.path} has no snapshot{'' if version is None else f' {version}'}")
        stream = self._fs.open(self._at(f"snapshots/{versions[-1] if version is None else version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        part, place = self._at(f"snapshots/.{uuid.uuid4().hex}"), self._at(f"snapshots/{manifest['version']:012d}.json")
        stream = self._fs.create(part, False)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        try:
            if self._fs.exists(place):
                raise Conflict(f"{place.toString()} is there")
            context = self._hadoop.FileContext.getFileContext(place.toUri(), self._conf)
            context.rename(part, place, self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0))
        except Exception as e:
            self._fs.delete(part, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"{place.toString()} is there") from e
            raise

    def _files(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        names = [f"{self.path}/{f}" for b, files in manifest["files"].items() for f in files if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*names) if names else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, or of the last one."""
        return self._files(self.manifest(version))

    def upsert(self, new: DataFrame, nothing_on_conflict: bool = False) -> int:
        """Publishes a version in which ``new`` has updated rows of equal keys (or left them) and
        added the others, and returns its number; without new rows none is published.

        Of new rows that share a key the one with the largest values counts. Rows with a null
        in their key are an error. New rows are written once, so what they are computed from is
        read once; then only the files of buckets that they touch are read and written anew.
        """
        manifest = self.manifest()
        key, schema = manifest["key"], StructType.fromJson(manifest["schema"])
        folder = f"data/{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64(*key), F.lit(manifest["buckets"])).cast("int")
        rows = new.select(*(F.col(f.name).cast(f.dataType) for f in schema))
        rows.withColumn(BUCKET, bucket).write.parquet(f"{self.path}/{folder}/new")
        rows = self.spark.read.parquet(f"{self.path}/{folder}/new")
        if not rows.filter(" OR ".join(f"`{k}` IS NULL" for k in key)).isEmpty():
            raise ValueError(f"a null in the key {key}")
        touched = sorted(r[BUCKET] for r in rows.select(BUCKET).distinct().collect())  # as many as there are buckets, at most
        if not touched:
            return manifest["version"]
        merged = K.upsert(self._files(manifest, touched), rows.drop(BUCKET), key, nothing_on_conflict)
        merged.withColumn(BUCKET, bucket).repartition(len(touched), BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}/merged")
        files = {b: names for b, names in manifest["files"].items() if int(b) not in touched}
        for b in touched:
            found = self._fs.globStatus(self._at(f"{folder}/merged/{BUCKET}={b}/part-*"))
            files[str(b)] = sorted(f"{folder}/merged/{BUCKET}={b}/{f.getPath().getName()}" for f in found or [])
        self._fs.delete(self._at(f"{folder}/new"), True)  # this run's own intermediate rows
        self._publish(manifest | {"version": manifest["version"] + 1, "files": files})
        return manifest["version"] + 1
