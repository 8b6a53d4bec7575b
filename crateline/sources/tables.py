"""Corpus tables: writing, publishing, loading and the run log."""

from __future__ import annotations

import json
from collections.abc import Mapping
from datetime import datetime, timezone
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from crateline.config import SERVED, Dials
from crateline.operators import relational as R
from crateline.operators.corpus import Catalogue, usable_label_refs
from crateline.sources import files


class NoData(LookupError):
    """Nothing has been published yet, which is not the same as an empty answer."""


def corpus_tables(cat: Catalogue, dials: Dials) -> dict[str, DataFrame]:
    """The six corpus tables. Records are unique by id (``last_records``), so rows are by release
    and position; a release's styles and genres are sets.

    A label with no id or a placeholder name is no row, but keeps its slot in the numbering.
    """
    return {
        "releases": cat.releases,
        "release_artists": cat.line,
        "release_credits": cat.credits,
        "release_labels": usable_label_refs(cat.label_refs, dials),
        "release_styles": R.ignore_by_key(cat.styles, ["release_id", "style"]),
        "release_genres": R.ignore_by_key(cat.genres, ["release_id", "genre"]),
    }


def rebuild(tables: Mapping[str, DataFrame], dest: str) -> None:
    """Each table replaces what the last run left; nothing is layered on it."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{dest}/{name}")


# The key a page looks rows up by: rows are clustered on it, so a lookup reads few groups.
LOOKUP_KEYS = {
    "artists": "id",
    "labels": "id",
    "releases": "id",
    "release_artists": "artist_id",
    "release_credits": "artist_id",
    "release_labels": "label_id",
    "artist_collaborators": "artist_id",
    "artist_labels": "artist_id",
    "label_roster": "label_id",
    "artist_coverage": "artist_id",
    "label_coverage": "label_id",
    "corpus_artists": "artist_id",
    "artist_relations": "artist_id",
    "artist_search": "id",
    "label_search": "id",
    "artist_postings": "text",
    "label_postings": "text",
    "artist_release_list": "artist_id",
    "label_release_list": "label_id",
}
_MANIFEST = "CURRENT"


# Published versions that stay: the current one, and those a reader may still hold.
KEPT_VERSIONS = 3


def publish_serving(
    tables: Mapping[str, DataFrame], dest: str, served: tuple[str, ...] = SERVED, kept: int = KEPT_VERSIONS
) -> str:
    """Write the served tables under a fresh version, then point readers at it in one step.

    Readers follow a small manifest that is renamed into place last, so a lost job never shows
    half a publication and a reader never finds an empty manifest. Rows are range-clustered by
    lookup key, so a lookup skips most row groups. Versions older than the ``kept`` last ones go.
    """
    version = uuid4().hex
    held = {name: tables[name] for name in served if name in tables}
    spark = next(iter(held.values())).sparkSession
    for name, df in held.items():
        key = LOOKUP_KEYS.get(name)
        laid = df if key is None else R.clustered(df, key)
        laid.write.parquet(f"{dest}/{version}/{name}")
    before = _manifest(spark, dest)
    versions = [version, *(before["versions"] if before else [])]
    text = json.dumps({"versions": versions[:kept], "tables": list(held)})
    files.replace_text(spark, f"{dest}/{_MANIFEST}", text)
    for old in versions[kept:]:
        files.delete(spark, f"{dest}/{old}")
    return version


def _manifest(spark: SparkSession, dest: str) -> dict | None:
    text = files.read_text(spark, f"{dest}/{_MANIFEST}")
    return json.loads(text) if text else None


def load_serving(spark: SparkSession, dest: str) -> dict[str, DataFrame]:
    current = _manifest(spark, dest)
    if current is None:
        raise NoData(f"nothing published at {dest}")
    version = current["versions"][0]
    return {name: spark.read.parquet(f"{dest}/{version}/{name}") for name in current["tables"]}


RUN_LOG = (
    "id string, step string, started_at string, finished_at string, source_file string, "
    "config_json string, stats_json string"
)


def run_record(
    stats: Mapping[str, int | float | None], step: str, source_file: str | None, config: Mapping, started_at: str
) -> dict[str, str | None]:
    """One run-log row: what the step counted and its config, both as JSON."""
    return {
        "id": uuid4().hex,
        "step": step,
        "started_at": started_at,
        "finished_at": datetime.now(timezone.utc).isoformat(),
        "source_file": source_file,
        "config_json": json.dumps(config, sort_keys=True),
        "stats_json": json.dumps(stats),
    }


def append_run(spark: SparkSession, record: Mapping[str, str | None], path: str) -> None:
    """A file of its own per run, written without a Spark job."""
    files.replace_text(spark, f"{path}/{record['id']}.json", json.dumps(record))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_LOG).json(path)
