"""Hashes of stored rows in files of known ranges, so that a look-up opens only files that can match.

    hashes/<table>/part=<part>/  _row_hash, load_id and file of each row, sorted by hash
    ranges/<table>/part=<part>/  least and greatest hash of each of those files
    commits/<table>.hashes/<n>   "<merged part> <version of the table it covers>"

Every load writes a part named after it before it commits, so a part is visible when its load is.
Hashes are spread evenly: a part of many files has narrow ranges, and k hashes meet at most k of its
files.  A small load is one file with a wide range, which most look-ups open; ``merge`` writes the
visible parts as one.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sluicegate.operators.dedup import ROW_HASH
from sluicegate.plans.store import LOAD, Store

PART = "part"
HASHES = T.StructType([
    T.StructField(ROW_HASH, T.LongType()), T.StructField(LOAD, T.StringType()),
    T.StructField("file", T.StringType()), T.StructField(PART, T.StringType())])
RANGES = T.StructType([
    T.StructField("hash_file", T.StringType()), T.StructField("low", T.LongType()),
    T.StructField("high", T.LongType()), T.StructField("n", T.LongType()), T.StructField(PART, T.StringType())])
#: Most rows of a file of hashes, and most files whose names are handed to a reader; where more can
#: match, the folder is read as a whole.
FILE_ROWS, MOST_FILES = 1_000_000, 10_000


class HashIndex:
    def __init__(self, store: Store, name: str, file_rows: int = FILE_ROWS, most_files: int = MOST_FILES):
        self.store, self.spark, self.name = store, store.spark, name
        self.file_rows, self.most_files = file_rows, most_files

    def add(self, load_id: str) -> None:
        """Index the rows of a load that were written; a repeated load replaces its part."""
        rows = self.spark.read.parquet(self.store.path("tables", self.name, f"{LOAD}={load_id}"))
        if ROW_HASH in rows.columns:
            self._write(rows.select(ROW_HASH, F.lit(load_id).alias(LOAD), F.col("_metadata.file_name").alias("file")), load_id)

    def merge(self, patience: float = 60.0) -> None:
        """Write the visible parts as one; loads that commit meanwhile keep their own."""
        until = time.monotonic() + patience
        while True:
            n, version = self.store.versions(self.name).agg(F.count(F.lit(1)), F.max("version")).first()
            if not n:
                return
            if n == version:  # every version names its load
                break
            if time.monotonic() > until:
                raise TimeoutError(f"a version of {self.name} was taken but does not name its load")
            time.sleep(0.2)
        part = f"merged-{uuid.uuid4().hex}"
        hashes = self._read("hashes", HASHES)
        self._write(hashes.join(self._visible(version), PART, "left_semi").select(ROW_HASH, LOAD, "file"), part)
        step = self.store.version(self._log) + 1
        while not self.store.commit(self._log, step, f"{part} {version}"):
            step += 1

    def rows(self, probes: DataFrame) -> DataFrame:
        """Rows of the table, among them all whose hash is a hash of ``probes`` (column ``_row_hash``).

        Read are: the ranges, the files of hashes whose range has a probe, and the files of rows
        that hold such a hash.
        """
        wanted = probes.select(ROW_HASH).distinct()
        opened = self._names(self._candidates(wanted), PART, "hash_file")
        if opened is None:
            hashes = self._read("hashes", HASHES).join(self._visible(), PART, "left_semi")
        else:
            hashes = self._files("hashes", HASHES, [f"{PART}={part}/{file}" for part, file in opened])
        hits = hashes.join(wanted, ROW_HASH, "left_semi").select(LOAD, "file").distinct()
        found = self._names(hits, LOAD, "file")
        if found is None:
            return self.store.table(self.name)
        schema = T.StructType([*self.store.recorded(self.name).fields, T.StructField(LOAD, T.StringType())])
        return self._files("tables", schema, [f"{LOAD}={load}/{file}" for load, file in found])

    # -- parts ----------------------------------------------------------------------

    @property
    def _log(self) -> str:
        return f"{self.name}.hashes"

    def _write(self, hashes: DataFrame, part: str) -> None:
        path = self.store.path("hashes", self.name, f"{PART}={part}")
        hashes.filter(F.col(ROW_HASH).isNotNull()).repartitionByRange(ROW_HASH).sortWithinPartitions(ROW_HASH).write.mode(
            "overwrite").option("maxRecordsPerFile", self.file_rows).parquet(path)
        stored = self.spark.read.schema(T.StructType(HASHES.fields[:-1])).parquet(path)
        stored.groupBy(F.col("_metadata.file_name").alias("hash_file")).agg(
            F.min(ROW_HASH).alias("low"), F.max(ROW_HASH).alias("high"), F.count(F.lit(1)).alias("n")).write.mode(
            "overwrite").parquet(self.store.path("ranges", self.name, f"{PART}={part}"))

    def _visible(self, upto: int | None = None) -> DataFrame:
        """Names of the parts in force: the last merged one and the committed loads it does not cover."""
        log = self.store.versions(self._log).withColumns({
            PART: F.split(LOAD, " ")[0], "covers": F.split(LOAD, " ")[1].cast("long")})
        newest = log.agg(F.max(F.struct("covers", "version", PART))).first()[0]
        taken = self.store.versions(self.name)
        loads = self.store.committed_loads(self.name)
        if upto is not None:
            loads = loads.join(taken.filter(F.col("version") > upto), LOAD, "left_anti")
        if newest is None:
            return loads.select(F.col(LOAD).alias(PART))
        later = loads.join(taken.filter(F.col("version") <= newest["covers"]), LOAD, "left_anti")
        return later.select(F.col(LOAD).alias(PART)).union(self.spark.createDataFrame([(newest[PART],)], f"{PART} string"))

    def _candidates(self, wanted: DataFrame) -> DataFrame:
        """Files of hashes whose range may hold a wanted hash.

        A range is named by the two or three cells it touches among cells as wide as itself.
        Wanted hashes are reduced to the least and the greatest of each cell before they meet
        the ranges, so a wide range gathers no rows.
        """
        ranges = self._read("ranges", RANGES).join(self._visible(), PART, "left_semi")
        width = F.col("high").cast("double") - F.col("low").cast("double")
        sized = ranges.withColumn("bits", F.least(F.lit(63), F.ceil(F.log2(width + 1))).cast("int"))
        sizes = [r["bits"] for r in sized.select("bits").distinct().collect()]  # 64 at most
        cells = sized.withColumn("cell", F.explode(F.sequence(_cell("low"), _cell("high"))))
        levels = F.array(*[F.lit(s) for s in sizes]).cast("array<int>")
        placed = wanted.withColumn("bits", F.explode(levels)).groupBy("bits", _cell(ROW_HASH).alias("cell")).agg(
            F.min(ROW_HASH).alias("least"), F.max(ROW_HASH).alias("greatest"))
        meeting = cells.join(placed, ["bits", "cell"]).filter("least <= high AND greatest >= low")
        return meeting.select(PART, "hash_file").distinct()

    # -- files ----------------------------------------------------------------------

    def _names(self, files: DataFrame, *columns: str) -> list[tuple] | None:
        """The names, or None when there are more than a reader should be handed."""
        names = [tuple(r) for r in files.select(*columns).limit(self.most_files + 1).collect()]
        return names if len(names) <= self.most_files else None

    def _files(self, kind: str, schema: T.StructType, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        base = self.store.path(kind, self.name)
        return self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/{n}" for n in sorted(names)])

    def _read(self, kind: str, schema: T.StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(self.store.path(kind, self.name))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)


def _cell(column: str) -> Column:
    return F.call_function("shiftright", F.col(column), F.col("bits"))
