"""Small files and listings of any file system Spark reads, without a Spark job."""

from __future__ import annotations

import hashlib
from uuid import uuid4

from pyspark.sql import SparkSession


def located(spark: SparkSession, path: str):
    """The path and its file system."""
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    return held, held.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    held, fs = located(spark, path)
    return fs.exists(held)


def delete(spark: SparkSession, path: str) -> None:
    held, fs = located(spark, path)
    fs.delete(held, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The whole file, which the caller knows to be small; None if there is none."""
    held, fs = located(spark, path)
    if not fs.exists(held):
        return None
    stream = fs.open(held)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """The whole text under a name of its own, then one rename over the old file.

    On file systems without an atomic rename (object stores) a reader may for a moment find no
    file; what it finds is never half of one.
    """
    fresh, fs = located(spark, f"{path}.{uuid4().hex}")
    out = fs.create(fresh, False)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    context = hadoop.FileContext.getFileContext(fresh.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(fresh, located(spark, path)[0], options)


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies directly in a folder; nothing if there is no folder."""
    held, fs = located(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(held)) if fs.exists(held) else []


def listing_digest(spark: SparkSession, *paths: str) -> str:
    """A digest of the names, sizes and write times of all files below: what a rerun reads anew."""
    seen = []
    for path in paths:
        held, fs = located(spark, path)
        files = fs.listFiles(held, True)
        while files.hasNext():
            f = files.next()
            seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()
