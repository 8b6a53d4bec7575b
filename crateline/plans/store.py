"""A stage that outlives its session: tables are found again by what they are made from.

A table's key is a digest of its name, the dials it depends on, the keys of the tables before it
and the digests of the sources it reads. A table that is complete under its key is read, with no
job; any other is built and marked complete last. Changing a dial therefore rebuilds exactly the
tables that depend on it, and results for several settings lie side by side.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, is_dataclass
from hashlib import sha256
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from crateline.plans.staging import Stage
from crateline.sources import files

_MARKER = "COMPLETE"


@dataclass(frozen=True)
class Recipe:
    """What a table is made from: tables before it, sources by name, dials by name."""

    after: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    dials: tuple[str, ...] = ()


class Incomplete(LookupError):
    """A table that should be read is not stored for these dials and sources."""


class Store(Stage):
    """Tables of ``recipes`` kept in ``folder`` for the given dials and source digests.

    Tables without a recipe are written for this run alone. ``built`` and ``reused`` name what
    this run did. A run that is lost half way leaves no marker, so its tables are built again.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        recipes: Mapping[str, Recipe],
        dials: object,
        sources: Mapping[str, str],
    ):
        super().__init__(spark, folder)
        self.recipes, self.dials, self.sources = dict(recipes), dials, dict(sources)
        self.built: list[str] = []
        self.reused: list[str] = []
        self._keys: dict[str, str] = {}

    def key(self, name: str) -> str:
        if name not in self._keys:
            recipe = self.recipes[name]
            values = {d: getattr(self.dials, d) for d in recipe.dials}
            made_from = [
                name,
                {d: asdict(v) if is_dataclass(v) else v for d, v in values.items()},
                [self.key(before) for before in recipe.after],
                [self.sources[source] for source in recipe.sources],
            ]
            text = json.dumps(made_from, sort_keys=True, default=asdict)
            self._keys[name] = sha256(text.encode()).hexdigest()[:32]
        return self._keys[name]

    def _place(self, name: str) -> str:
        return f"{self.folder}/{name}/{self.key(name)}"

    def marker(self, name: str) -> dict | None:
        """What was noted when the table was completed, or None."""
        text = files.read_text(self.spark, f"{self._place(name)}/{_MARKER}")
        return json.loads(text) if text else None

    def _stored(self, name: str) -> DataFrame | None:
        held = self.marker(name)
        if held is None:
            return None
        self.counts[name] = held["counts"]
        schema = StructType.fromJson(held["schema"])
        return self.read_back(name, schema, f"{self._place(name)}/{held['data']}")

    def need(self, *names: str) -> dict[str, DataFrame]:
        """Stored tables, read with no job; ``Incomplete`` names those that are not there."""
        for name in names:
            if name not in self._held and (df := self._stored(name)) is not None:
                self._held[name] = df
                self.reused.append(name)
        missing = [name for name in names if name not in self._held]
        if missing:
            raise Incomplete(f"not stored for these dials and sources: {', '.join(missing)}")
        return {name: self._held[name] for name in names}

    def _write(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self.recipes:
            return super()._write(name, build)
        stored = self._stored(name)
        if stored is not None:
            self.reused.append(name)
            return stored
        data = uuid4().hex
        df, counts = self.counted(name, build())
        df.write.parquet(f"{self._place(name)}/{data}")
        note = {"data": data, "schema": json.loads(df.schema.json()), "counts": counts()}
        files.replace_text(self.spark, f"{self._place(name)}/{_MARKER}", json.dumps(note))
        self.built.append(name)
        return self.read_back(name, df.schema, f"{self._place(name)}/{data}")

    def clear(self, *names: str) -> None:
        """Forget the named tables for these dials, so that the next run builds them again."""
        for name in names:
            files.delete(self.spark, f"{self._place(name)}/{_MARKER}")
            self._held.pop(name, None)

    def prune(self) -> list[str]:
        """Delete what is stored under other dials or sources, and what was never completed."""
        gone = []
        for name in self.recipes:
            kept = self.marker(name)
            for key in files.names(self.spark, f"{self.folder}/{name}"):
                if key != self.key(name):
                    gone.append(f"{name}/{key}")
                    files.delete(self.spark, f"{self.folder}/{name}/{key}")
            for data in files.names(self.spark, self._place(name)):
                if data != _MARKER and (kept is None or data != kept["data"]):
                    gone.append(f"{name}/{self.key(name)}/{data}")
                    files.delete(self.spark, f"{self._place(name)}/{data}")
        return gone
