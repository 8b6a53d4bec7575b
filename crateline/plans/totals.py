"""Stored totals of the seed artists' appearances, counted again only when they cannot be trusted."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import DataFrame, Row, SparkSession

from crateline.operators import measure as M
from crateline.operators import relational as R
from crateline.sources import files
from crateline.sources.tables import NoData

_MARKER = "BUILT"
SCHEMA = "artist_id bigint, total bigint"


@dataclass(frozen=True)
class Totals:
    """(artist_id, total), and the verdict that led to them."""

    totals: DataFrame
    verdict: Row


def store_totals(totals: DataFrame, folder: str, built_from: str | None) -> DataFrame:
    """Replace what the folder holds, noting the dump it was counted from; the marker goes last."""
    spark = totals.sparkSession
    before = files.read_text(spark, f"{folder}/{_MARKER}")
    data = uuid4().hex
    totals.select("artist_id", "total").write.parquet(f"{folder}/{data}")
    files.replace_text(spark, f"{folder}/{_MARKER}", json.dumps({"data": data, "built_from": built_from}))
    # A reader that has just looked the old marker up may still be reading what it names.
    for old in files.names(spark, folder):
        if old not in (_MARKER, data) and (before is None or old != json.loads(before)["data"]):
            files.delete(spark, f"{folder}/{old}")
    return spark.read.schema(SCHEMA).parquet(f"{folder}/{data}")


def load_totals(spark: SparkSession, folder: str) -> tuple[DataFrame, str | None]:
    """The stored totals and the dump they were counted from; empty and None if there are none."""
    text = files.read_text(spark, f"{folder}/{_MARKER}")
    if text is None:
        return spark.createDataFrame([], SCHEMA), None
    held = json.loads(text)
    return spark.read.schema(SCHEMA).parquet(f"{folder}/{held['data']}"), held["built_from"]


def refresh_totals(
    folder: str,
    seeds: DataFrame,
    scan: Callable[[], DataFrame],
    dump_on_disk: str | None,
    forced: bool = False,
) -> Totals:
    """Judge the stored totals and act on it: reuse them, or count those of ``seeds`` again.

    ``scan`` gives (artist_id, total) over the whole dump and is called for a rescan only. Totals
    that cannot be trusted and no dump to count from are ``NoData``.
    """
    held, built_from = load_totals(seeds.sparkSession, folder)
    verdict = M.totals_cache_verdict(M.totals_cache_state(held, seeds, built_from, dump_on_disk, forced)).head()
    if verdict["action"] == "reuse":
        return Totals(held, verdict)
    if dump_on_disk is None:
        raise NoData(f"totals at {folder} cannot be trusted ({verdict['why']}), and there is no dump to count from")
    return Totals(store_totals(R.semi_join(scan(), seeds, "artist_id"), folder, dump_on_disk), verdict)
