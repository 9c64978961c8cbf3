"""Keyed tables that are merged when read: a base and the changes since.

An upsert or a delete of k keys writes k rows, not the table: a folder of changed rows with a delete
mark, dealt to hash buckets of the key like the base.  A reader takes the newest change of each key
and the base rows whose key has none.  Compaction writes what a reader sees as a new base.  Folders
become part of the table when they take a version of it, so writers do not lose each other's
changes, and a base covers exactly the versions it was read from.

    tables/<name>/base-<id>/_bucket=<n>/    all rows up to a version
    tables/<name>/change-<id>/_bucket=<n>/  rows of one change, with ``_deleted``
    commits/<name>/<version>                "change-<id>", or "base-<id> <version it covers>"
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sluicegate.operators.changes import latest_per_key
from sluicegate.operators.dedup import null_safe_join
from sluicegate.plans.store import LOAD, Store

BUCKET, DELETED, VERSION = "_bucket", "_deleted", "_version"


class KeyedTable:
    def __init__(self, store: Store, name: str, schema: T.StructType, keys: Sequence[str], buckets: int = 16):
        self.store, self.name, self.keys, self.buckets = store, name, list(keys), buckets
        self.schema = schema
        self._stored = T.StructType([*schema.fields, T.StructField(DELETED, T.BooleanType()), T.StructField(BUCKET, T.IntegerType())])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, folder: str) -> None:
        """One file per bucket that has rows."""
        dealt = rows.select(*self.schema.fieldNames(), DELETED, self._bucket().alias(BUCKET)).repartition(self.buckets, BUCKET)
        dealt.write.mode("overwrite").partitionBy(BUCKET).parquet(self.store.path("tables", self.name, folder))

    def _take(self, entry: str) -> int:
        """The version that ``entry`` took."""
        version = self.store.version(self.name) + 1
        while not self.store.commit(self.name, version, entry):
            version += 1
        return version

    def _read(self, folder: str) -> DataFrame:
        return self.store.spark.read.schema(self._stored).parquet(self.store.path("tables", self.name, folder))

    def _parts(self) -> tuple[DataFrame | None, list[tuple[int, str]], int]:
        """The base, the changes after it with their versions, and the last version.

        As many entries reach the driver as there were changes since the last compaction, and
        one per compaction.
        """
        log = self.store.versions(self.name).withColumns({
            "folder": F.split(LOAD, " ")[0], "covers": F.get(F.split(LOAD, " "), F.lit(1)).cast("long")})
        newest = log.filter("covers IS NOT NULL").agg(F.max(F.struct("covers", "version", "folder"))).first()[0]
        covered = newest["covers"] if newest else 0
        changes = log.filter(F.col("covers").isNull() & (F.col("version") > covered)).orderBy("version").collect()
        base = self._read(newest["folder"]) if newest else None
        return base, [(r["version"], r["folder"]) for r in changes], max([covered, *(r["version"] for r in changes)])

    def _change(self, rows: DataFrame) -> int:
        folder = f"change-{uuid.uuid4().hex}"
        self._write(rows, folder)
        return self._take(folder)

    def upsert(self, rows: DataFrame, order: Sequence[Column] | None = None) -> int:
        """Rows of new and known keys; ``rows`` has one row per key, or its last by ``order``."""
        chosen = rows if order is None else latest_per_key(rows, self.keys, order)
        return self._change(chosen.withColumn(DELETED, F.lit(False)))

    def delete(self, keys: DataFrame) -> int:
        rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema if f.name not in self.keys]
        return self._change(keys.select(*self.keys).distinct().select(*self.keys, *rest, F.lit(True).alias(DELETED)))

    def _merged(self) -> tuple[DataFrame, int]:
        base, changes, version = self._parts()
        columns = self.schema.fieldNames()
        if not changes:
            rows = base if base is not None else self.store.spark.createDataFrame([], self._stored)
            return rows.select(*columns, BUCKET), version
        changed = None
        for number, folder in changes:
            part = self._read(folder).withColumn(VERSION, F.lit(number))
            changed = part if changed is None else changed.unionByName(part)
        # A key is in one bucket, so changes and base meet bucket by bucket.
        newest = latest_per_key(changed, [*self.keys, BUCKET], [F.col(VERSION)])
        rows = newest.filter(~F.col(DELETED)).select(*columns, BUCKET)
        if base is not None:
            untouched = null_safe_join(base, newest.select(*self.keys, BUCKET), [*self.keys, BUCKET], "left_anti")
            rows = untouched.select(*columns, BUCKET).unionByName(rows)
        return rows, version

    def rows(self) -> DataFrame:
        """The table as it is now."""
        return self._merged()[0].select(*self.schema.fieldNames())

    def rows_of(self, keys: DataFrame) -> DataFrame:
        """Rows of some keys; the buckets of other keys are not read."""
        wanted = keys.select(*self.keys).distinct().withColumn(BUCKET, self._bucket())
        return null_safe_join(self._merged()[0], wanted, [*self.keys, BUCKET], "left_semi").select(*self.schema.fieldNames())

    def compact(self) -> int:
        """Write the table as a base; changes made meanwhile are not in it and stay in force."""
        rows, version = self._merged()
        folder = f"base-{uuid.uuid4().hex}"
        self._write(rows.withColumn(DELETED, F.lit(False)), folder)
        return self._take(f"{folder} {version}")
