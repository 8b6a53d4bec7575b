"""Session settings, written intermediates and batch helpers that the operators share."""

from __future__ import annotations

import os
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crateline.plans.staging import shared_folder, tune

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# Rows handed to a Python worker at once, and bytes of text worked on at once. Both bound a
# task's memory and change no result.
ROWS_PER_BATCH = 512
TEXT_BYTES = 1 << 20

WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Join and batch settings. Workers find this package beside the driver's copy or by --py-files."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    environment = spark.sparkContext.environment
    held = environment.get("PYTHONPATH", "")
    if ROOT not in held.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, (held, ROOT)))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str, compression: str = "snappy", rows_per_file: int | None = None) -> DataFrame:
    """The rows written once to the folder the cluster shares: lineage ends at the files. Readers and writers hold a
    batch of a file's rows at once, so very large rows need files of few rows."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid4().hex}"
    options = {} if rows_per_file is None else {"maxRecordsPerFile": rows_per_file}
    df.write.options(**options).parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, changes: Mapping[str, str]) -> Iterator[None]:
    """Settings for the jobs started within, as they were after."""
    held = {name: spark.conf.get(name, None) for name in changes}
    for name, value in changes.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in held.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def remainder(doc_id: Column | str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % by


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of text each; a longer text stands alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, size in enumerate(sizes.tolist()):
            if held + size > limit and i > start:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if batch.num_rows > start:
            yield batch.slice(start)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 … base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all others (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def to_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
    )
