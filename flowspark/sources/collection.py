"""A keyed collection in hash buckets with versions: an upsert rewrites only the buckets that it touches.

Layout of a collection folder::

    data/<write>/bucket=<b>/   the rows of bucket b as one write left them
    manifests/<version>.json   which write holds each bucket in that version, with its row count

A write puts its buckets into a new folder and then commits a manifest under the next version number.  The
commit is one rename that fails if the name is taken, so readers see a version as a whole or not at all, a crash
before it changes nothing, and of two writers that start from one version the second has to try again.
Readers take the newest manifest, and reads by key take only the buckets of those keys.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.operators.evaluation import latest
from flowspark.session import written

BUCKET = "_bucket"


class VersionTaken(RuntimeError):
    """Another writer committed the next version first."""


@dataclass
class Manifest:
    version: int
    key: str
    buckets: int
    schema: str
    folders: dict[int, str] = field(default_factory=dict)
    rows: dict[int, int] = field(default_factory=dict)

    @classmethod
    def read(cls, text: str) -> Manifest:
        found = cls(**json.loads(text))
        found.folders, found.rows = ({int(k): v for k, v in x.items()} for x in (found.folders, found.rows))
        return found


class Collection:
    """Rows by ``key`` below ``path``; create it once with :meth:`create`, then open it by its path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    # ------------------------------------------------------------ manifests

    def _file(self, *parts: str):
        return self._hadoop.Path("/".join((self.path, *parts)))

    def _system(self):
        return self._file().getFileSystem(self._conf)

    def versions(self) -> list[int]:
        system, folder = self._system(), self._file("manifests")
        if not system.exists(folder):
            return []
        names = [s.getPath().getName() for s in system.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def manifest(self, version: int | None = None) -> Manifest:
        if version is None:
            version = self.versions()[-1]
        stream = self._system().open(self._file("manifests", f"{version}.json"))
        try:
            return Manifest.read(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: Manifest) -> None:
        """Publish a version: written aside, then renamed to its number, which must be free."""
        system = self._system()
        aside, target = self._file("manifests", f".{uuid.uuid4().hex}.tmp"), self._file("manifests", f"{manifest.version}.json")
        stream = system.create(aside, False)
        stream.write(bytearray(json.dumps(manifest.__dict__).encode()))
        stream.close()
        rename = self._hadoop.Options.Rename
        kinds = self.spark._sc._gateway.new_array(rename, 1)
        kinds[0] = rename.NONE
        try:
            self._hadoop.FileContext.getFileContext(target.toUri(), self._conf).rename(aside, target, kinds)
        except Exception as problem:
            system.delete(aside, False)
            if system.exists(target):
                raise VersionTaken(f"version {manifest.version} of {self.path} is taken") from problem
            raise

    # ------------------------------------------------------------ writes

    @classmethod
    def create(cls, df: DataFrame, path: str, key: str = "id", buckets: int = 64) -> Collection:
        """A new collection with the rows of ``df``, whose keys are unique.  A bucket is what an upsert rewrites at least."""
        own = cls(df.sparkSession, path)
        if own.versions():
            raise VersionTaken(f"{path} is a collection already")
        schema = df.schema.json()
        for flag in ("nullable", "containsNull", "valueContainsNull"):  # later rows may lack any value
            schema = schema.replace(f'"{flag}":false', f'"{flag}":true')
        start = Manifest(0, key, buckets, schema)
        start.folders, start.rows = own._write(df, start)
        own._commit(start)
        return own

    def _bucket(self, manifest: Manifest) -> Column:
        return F.pmod(F.xxhash64(manifest.key), F.lit(manifest.buckets).cast("long")).cast("int")

    def _write(self, df: DataFrame, manifest: Manifest) -> tuple[dict[int, str], dict[int, int]]:
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        placed = df.withColumn(BUCKET, self._bucket(manifest))
        # a file per bucket and write; the shuffle is by a hash of the key, so no bucket is a hot one
        placed.repartition(BUCKET).write.partitionBy(BUCKET).parquet(folder)
        found = self.spark.read.schema(T.StructType([T.StructField(BUCKET, T.IntegerType())])).parquet(folder)
        rows = {r[BUCKET]: r["count"] for r in found.groupBy(BUCKET).count().collect()}  # from the files' footers; a row per bucket
        return {b: f"{folder}/{BUCKET}={b}" for b in rows}, rows

    def upsert(self, incoming: DataFrame, order: str = "seq", attempts: int = 3) -> Manifest:
        """New rows replace those of the same key; within the new rows the last by ``order`` wins.

        Columns that the collection does not have, ``order`` among them, are left out; those that ``incoming`` does not have are null.
        """
        for attempt in range(attempts):
            now = self.manifest()
            try:
                after = self._merged(now, incoming, order)
                if after is not now:
                    self._commit(after)
                return after
            except VersionTaken:
                if attempt == attempts - 1:
                    raise
        raise AssertionError

    def _merged(self, now: Manifest, incoming: DataFrame, order: str) -> Manifest:
        schema = T.StructType.fromJson(json.loads(now.schema))
        newest = latest(incoming, [now.key], [order])
        newest = newest.select(*[(F.col(f"`{f.name}`") if f.name in newest.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
        newest = written(newest)  # read for its buckets, the join and the union
        touched = {r[0] for r in newest.select(self._bucket(now)).distinct().collect()}  # bucket numbers
        if not touched:
            return now
        held = self._read(now, touched).join(newest.select(now.key), now.key, "left_anti")
        folders, rows = self._write(held.unionByName(newest), now)
        kept = {b: f for b, f in now.folders.items() if b not in touched}
        return Manifest(now.version + 1, now.key, now.buckets, now.schema, {**kept, **folders}, {**{b: now.rows[b] for b in kept}, **rows})

    def delete(self, keys: DataFrame) -> Manifest:
        """Remove the rows whose key is in ``keys``; only their buckets are rewritten."""
        now = self.manifest()
        gone = keys.select(F.col(now.key).cast(T.StructType.fromJson(json.loads(now.schema))[now.key].dataType)).distinct()
        touched = {r[0] for r in gone.select(self._bucket(now)).distinct().collect()}
        folders, rows = self._write(self._read(now, touched).join(gone, now.key, "left_anti"), now)
        kept = {b: f for b, f in now.folders.items() if b not in touched}
        after = Manifest(now.version + 1, now.key, now.buckets, now.schema, {**kept, **folders}, {**{b: now.rows[b] for b in kept}, **rows})
        self._commit(after)
        return after

    def reset(self) -> Manifest:
        """An empty version; the older ones stay readable until they are vacuumed."""
        now = self.manifest()
        after = Manifest(now.version + 1, now.key, now.buckets, now.schema)
        self._commit(after)
        return after

    def vacuum(self, keep: int = 1) -> int:
        """Delete all versions but the newest ``keep`` and every write that these do not use; returns how many writes went."""
        system, versions = self._system(), self.versions()
        used = {f.rsplit("/", 2)[-2] for v in versions[-keep:] for f in self.manifest(v).folders.values()}
        for version in versions[:-keep]:
            system.delete(self._file("manifests", f"{version}.json"), False)
        writes = [s.getPath() for s in system.listStatus(self._file("data"))]
        old = [p for p in writes if p.getName() not in used]
        for path in old:
            system.delete(path, True)
        return len(old)

    # ------------------------------------------------------------ reads

    def _read(self, manifest: Manifest, buckets: Iterable[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(manifest.schema))
        folders = [f for b, f in sorted(manifest.folders.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def rows(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the newest by default."""
        return self._read(self.manifest(version))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of the given keys, read from their buckets only."""
        now = self.manifest()
        wanted = keys.select(now.key).distinct()
        touched = {r[0] for r in wanted.select(self._bucket(now)).distinct().collect()}
        return self._read(now, touched).join(wanted, now.key, "left_semi")

    def size(self) -> int:
        """How many rows the newest version has, from its manifest alone."""
        return sum(self.manifest().rows.values())
