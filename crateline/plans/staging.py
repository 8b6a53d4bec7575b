"""Written intermediates in the cluster's shared folder, and the session's join settings."""

from __future__ import annotations

import tempfile
import time
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SETTINGS = {
    # Runtime join choice by measured size, and splitting of hot keys even where the split
    # costs one more shuffle.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # Lists per group are cut on the map side whatever their length.
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000000",
    # Buckets are written in order, one file each; joins and groups by their key need no other sort.
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    # Tables whose rows were counted are as large as these rows, not as their compressed files.
    "spark.sql.cbo.planStats.enabled": "true",
}


# Input per shuffle partition: columns are pruned and rows counted before most shuffles.
INPUT_PER_PARTITION = 1 << 30


# Bytes of rows that a byte of a table file is taken for where its rows are not counted.
BYTES_PER_FILE_BYTE = 8.0


def tune(spark: SparkSession, input_bytes: int | None = None) -> SparkSession:
    """Apply the settings; with the input's size given, start shuffles with enough partitions and
    take its files for the rows they hold.

    The runtime merges partitions that turn out small, so a high start costs little.
    """
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    if input_bytes is not None:
        spark.conf.set("spark.sql.sources.fileCompressionFactor", str(BYTES_PER_FILE_BYTE))
        wanted = -(-input_bytes // INPUT_PER_PARTITION)
        if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
            spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(wanted))
    return spark


# Input per bucket of tables that are dealt by a key: rows are wider in memory than in the columns they come from.
INPUT_PER_BUCKET = 8 << 20


def buckets_for(spark: SparkSession, input_bytes: int) -> int:
    """How many buckets tables of so much input are dealt into: they grow with it, and every core has one."""
    return max(spark.sparkContext.defaultParallelism, -(-input_bytes // INPUT_PER_BUCKET))


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size of a file or folder, from the file system's listing alone."""
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    return held.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(held).getLength()


def shared_folder(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names. A local session without one gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder every executor reaches")
    folder = tempfile.mkdtemp(prefix="crateline-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


# How long counts of a finished job may take to arrive before they are taken again.
ARRIVAL_SECONDS = 5.0


def arrived(seen: Observation) -> dict | None:
    """What a finished job observed. None if its plan ran without the observed rows (an empty
    other side lets the optimizer drop them) or in another session than theirs."""
    end = time.monotonic() + ARRIVAL_SECONDS
    while not seen._jo.future().isCompleted():
        if time.monotonic() > end:
            return None
        time.sleep(0.005)
    return seen.get if seen._jo.getRow().length() else None


# Intermediates are written once and read a few times.
COMPRESSION = "zstd"

# The optimizer is told the rows of larger tables. Files hold them in a tenth of the memory or less, so by its files a
# table of many rows looks small enough for a broadcast that the driver cannot hold.
LEAST_COUNTED = 100_000


class Stage:
    """Tables written once and read back: lineage ends at the file, not at an executor.

    ``counts`` holds what was counted while each table was written: its rows, and whatever its
    build asked to ``watch``. Counts of rows on their way to a shuffle may take in a map task that
    a lost executor made run twice; counts of written rows do not.
    """

    def __init__(
        self, spark: SparkSession, folder: str | None = None, keys: Mapping[str, str] | None = None, buckets: int = 0
    ):
        """Tables named in ``keys`` are written as ``buckets`` buckets by that column, each in its order, so joins and
        groups by it read them without another shuffle or sort; their builds ``deal`` rows that do not come from such
        tables."""
        self.spark = spark
        self.keys, self.buckets = dict(keys or {}) if buckets else {}, buckets
        self.folder = folder or f"{shared_folder(spark)}/stage-{uuid4().hex}"
        self.counts: dict[str, dict[str, int]] = {}
        self._held: dict[str, DataFrame] = {}
        self._watched: dict[str, list[tuple[Observation, DataFrame, list[Column]]]] = {}

    def watch(self, name: str, df: DataFrame, **measures: Column) -> DataFrame:
        """The same rows, measured by the job that writes table ``name``; use them there once."""
        seen, columns = Observation(), [m.alias(n) for n, m in measures.items()]
        self._watched.setdefault(name, []).append((seen, df, columns))
        return df.observe(seen, *columns)

    def counted(self, name: str, df: DataFrame) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
        """The rows to write, and what to call after writing them for all that was counted."""
        watching = self.watch(name, df, rows=F.count("*"))

        def counts() -> dict[str, int]:
            found: dict[str, int] = {}
            for seen, source, columns in self._watched.pop(name):
                measured = arrived(seen)
                # A one-row aggregate: counts again what the job had no need to read.
                found.update(measured if measured is not None else source.agg(*columns).head().asDict())
            self.counts[name] = {n: int(v or 0) for n, v in found.items()}
            return self.counts[name]

        return watching, counts

    def deal(self, df: DataFrame, key: str) -> DataFrame:
        """Rows on their way into a table of buckets; as they are where tables have none."""
        return df.repartition(self.buckets, key) if self.buckets else df

    def _declare(self, name: str, schema: StructType, path: str, layout: str = "") -> str:
        table = f"kept_{uuid4().hex}_{name}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        self.spark.sql(
            f"CREATE TABLE {table} ({columns}) USING parquet OPTIONS (compression '{COMPRESSION}') {layout} LOCATION '{path}'"
        )
        return table

    def read_back(self, name: str, schema: StructType, path: str, table: str | None = None) -> DataFrame:
        """A table that was written, its rows known to the optimizer where they are many."""
        if self.counts[name]["rows"] >= LEAST_COUNTED:
            table = table or self._declare(name, schema, path)
            self.spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS")
        return self.spark.read.table(table) if table else self.spark.read.schema(schema).parquet(path)

    def _write(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        df, counts = self.counted(name, build())
        path, table = f"{self.folder}/{name}", None
        if name in self.keys:
            key = f"(`{self.keys[name]}`)"
            table = self._declare(name, df.schema, path, f"CLUSTERED BY {key} SORTED BY {key} INTO {self.buckets} BUCKETS")
            df.write.insertInto(table)
        else:
            df.write.mode("overwrite").parquet(path, compression=COMPRESSION)
        counts()
        return self.read_back(name, df.schema, path, table)

    def table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._held:
            self._held[name] = self._write(name, build)
        return self._held[name]

    def tables(self, builds: Mapping[str, Callable[[], DataFrame]]) -> dict[str, DataFrame]:
        """Tables that do not need each other, their jobs submitted together."""
        due = {name: build for name, build in builds.items() if name not in self._held}
        if due:
            with ThreadPoolExecutor(len(due)) as pool:
                self._held.update(zip(due, pool.map(self._write, due.keys(), due.values())))
        return {name: self._held[name] for name in builds}
