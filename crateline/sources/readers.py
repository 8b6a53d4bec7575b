"""Snapshot readers: nested XML dumps, plain or gzipped, to nested rows.

A gzip file is one task whatever its size, so a dump is read once, spread with
``to_bronze`` and every later pass scans the Parquet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crateline.operators.relational import replace_by_key
from crateline.config import SAMPLE_SIZE
from crateline.functions.predicates import parse_year

# Leaving the tracklist out of the schema skips the whole subtree, so track-level people
# are never mistaken for release-level ones.
_PERSON = "array<struct<id:string,name:string,join:string,role:string>>"
RELEASE_XML = (
    "_id string, title string, released string, "
    f"artists struct<artist:{_PERSON}>, extraartists struct<artist:{_PERSON}>, "
    "labels struct<label:array<struct<_id:string,_name:string,_catno:string>>>, "
    "styles struct<style:array<string>>, genres struct<genre:array<string>>"
)
_RELATED = "struct<name:array<struct<_id:string,_VALUE:string>>>"
ARTIST_XML = (
    "id string, name string, realname string, profile string, urls struct<url:array<string>>, "
    f"aliases {_RELATED}, members {_RELATED}, `groups` {_RELATED}"
)
LABEL_XML = "id string, name string, profile string, urls struct<url:array<string>>"


def _xml(spark: SparkSession, path: str | Sequence[str], tag: str, schema: str) -> DataFrame:
    """Any malformed record aborts the read."""
    reader = spark.read.format("xml").schema(schema)
    options = {"rowTag": tag, "mode": "FAILFAST", "ignoreSurroundingSpaces": "true"}
    return reader.options(**options).load(path if isinstance(path, str) else list(path))


def _or_empty(array: Column, kind: str) -> Column:
    return F.coalesce(array, F.array().cast(f"array<{kind}>"))


def _blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def _number(text: Column) -> Column:
    return F.trim(text).try_cast("bigint")


def read_releases(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(id, title, year, artists, credits, labels, styles, genres), one row per release."""
    raw = _xml(spark, path, "release", RELEASE_XML)
    person = "struct<id:string,name:string,join:string,role:string>"
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    # A person with no usable id is id 0, which selection treats as a placeholder.
    person_id = lambda p: F.coalesce(_number(p["id"]), F.lit(0).cast("bigint")).alias("id")
    label = "struct<_id:string,_name:string,_catno:string>"
    return raw.select(
        _number(F.col("_id")).alias("id"),
        text(F.col("title")).alias("title"),
        parse_year(F.col("released")).alias("year"),
        F.transform(
            _or_empty(F.col("artists.artist"), person),
            lambda p: F.struct(
                person_id(p), text(p["name"]).alias("name"), _blank_to_null(p["join"]).alias("join_phrase")
            ),
        ).alias("artists"),
        F.transform(
            _or_empty(F.col("extraartists.artist"), person),
            lambda p: F.struct(
                person_id(p), text(p["name"]).alias("name"), text(p["role"]).alias("role")
            ),
        ).alias("credits"),
        F.transform(
            _or_empty(F.col("labels.label"), label),
            lambda l: F.struct(
                # No id attribute is no id; an empty one reads as 0.
                F.when(F.trim(l["_id"]) == "", 0).otherwise(_number(l["_id"])).alias("id"),
                F.coalesce(l["_name"], F.lit("")).alias("name"),
                _blank_to_null(l["_catno"]).alias("catno"),
            ),
        ).alias("labels"),
        F.transform(_or_empty(F.col("styles.style"), "string"), lambda t: F.trim(t)).alias("styles"),
        F.transform(_or_empty(F.col("genres.genre"), "string"), lambda t: F.trim(t)).alias("genres"),
    )


def _links() -> Column:
    urls = F.transform(_or_empty(F.col("urls.url"), "string"), lambda t: F.trim(t))
    return F.filter(urls, lambda u: u != "").alias("urls")


def _related(section: str, kind: str) -> Column:
    names = _or_empty(F.col(f"{section}.name"), "struct<_id:string,_VALUE:string>")
    rows = F.transform(
        names,
        lambda n: F.struct(
            F.lit(kind).alias("kind"),
            _number(n["_id"]).alias("id"),
            F.coalesce(F.trim(n["_VALUE"]), F.lit("")).alias("name"),
        ),
    )
    return F.filter(rows, lambda r: r["id"] > 0)


def read_artists(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(id, name, real_name, profile, urls, relations); entities without an id are dropped."""
    return _entity(_xml(spark, path, "artist", ARTIST_XML)).select(
        "id",
        "name",
        _blank_to_null(F.col("realname")).alias("real_name"),
        "profile",
        "urls",
        F.concat(
            _related("aliases", "alias"), _related("members", "member"), _related("groups", "group")
        ).alias("relations"),
    ).transform(_flat_urls)


def read_labels(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(id, name, profile, urls); labels nested inside a label are not rows."""
    return (
        _entity(_xml(spark, path, "label", LABEL_XML))
        .select("id", "name", "profile", "urls")
        .transform(_flat_urls)
    )


def _entity(raw: DataFrame) -> DataFrame:
    return (
        raw.withColumn("id", _number(F.col("id")))
        .filter("id > 0")
        .withColumn("name", F.coalesce(F.trim("name"), F.lit("")))
        .withColumn("profile", _blank_to_null(F.col("profile")))
    )


def _flat_urls(df: DataFrame) -> DataFrame:
    return df.withColumn("urls", _links())


def in_dump_order(df: DataFrame, order: Column | None = None) -> DataFrame:
    """Adds ``_seq``: the given order, or the place in the dump by file, place of the block and row
    within it. To be asked for where the dump is read, before any shuffle."""
    if order is None:
        order = F.struct(F.input_file_name(), F.input_file_block_start(), F.monotonically_increasing_id())
    return df.withColumn("_seq", order)


def last_records(df: DataFrame, key: str = "id", order: Column | None = None) -> DataFrame:
    """One record per key, the last in the dump's or the given order."""
    return replace_by_key(in_dump_order(df, order), [key], "_seq").drop("_seq")


def to_bronze(df: DataFrame, path: str, key: str = "id", files: int | None = None) -> DataFrame:
    """Spread a parsed dump over many files once, in key order within each, and read it back.

    Of records that repeat a key the last one stays, as if each were written over the one before.
    """
    last = last_records(df, key)
    spread = last.repartition(key) if files is None else last.repartition(files, key)
    spread.sortWithinPartitions(key).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def latest_complete_snapshot(
    files: DataFrame, required: Sequence[str], pinned: str | None = None, name: str = "name"
) -> DataFrame:
    """(date): the newest date holding every required file type, from a listing of names."""
    pattern = r"_(\d{8})_([a-z]+)\.xml\.gz"
    parts = files.select(
        F.regexp_extract(name, pattern, 1).alias("date"), F.regexp_extract(name, pattern, 2).alias("type")
    ).filter(F.col("type").isin(list(required)))
    if pinned is not None:
        parts = parts.filter(F.col("date") == pinned)
    return (
        parts.groupBy("date")
        .agg(F.countDistinct("type").alias("have"))
        .filter(F.col("have") == len(set(required)))
        .select("date")
        .orderBy(F.col("date").desc())
        .limit(1)
    )


def newest_file(files: DataFrame, suffix: str) -> DataFrame:
    """(name): the last written file with a suffix, from a listing of (name, modified)."""
    held = files.filter(F.col("name").endswith(suffix))
    return held.orderBy(F.col("modified").desc(), F.col("name").desc()).select("name").limit(1)


def require_snapshot(found: DataFrame, pinned: str | None = None) -> str:
    row = found.head()
    if row is None:
        raise LookupError("no complete dump found" if pinned is None else f"no complete dump dated {pinned}")
    return row["date"]


def sample_snapshot(df: DataFrame, n: int = SAMPLE_SIZE, key: str = "id") -> DataFrame:
    """The first ``n`` records in dump order, which is id order."""
    return df.orderBy(key).limit(n)


def write_xml(df: DataFrame, path: str, root: str, row: str) -> None:
    df.write.format("xml").option("rootTag", root).option("rowTag", row).mode("overwrite").save(path)


def release_xml_rows(nested: DataFrame) -> DataFrame:
    """Nested releases in the shape the dump spells them, for writing a sample dump."""
    return nested.select(
        F.col("id").cast("string").alias("_id"),
        "title",
        F.struct(
            F.transform(
                "artists",
                lambda p: F.struct(
                    p["id"].cast("string").alias("id"), p["name"].alias("name"), p["join_phrase"].alias("join")
                ),
            ).alias("artist")
        ).alias("artists"),
        F.struct(
            F.transform(
                "credits",
                lambda p: F.struct(
                    p["id"].cast("string").alias("id"), p["name"].alias("name"), p["role"].alias("role")
                ),
            ).alias("artist")
        ).alias("extraartists"),
        F.struct(
            F.transform(
                "labels",
                lambda l: F.struct(
                    l["id"].cast("string").alias("_id"), l["name"].alias("_name"), l["catno"].alias("_catno")
                ),
            ).alias("label")
        ).alias("labels"),
        F.struct(F.col("styles").alias("style")).alias("styles"),
        F.struct(F.col("genres").alias("genre")).alias("genres"),
        F.col("year").cast("string").alias("released"),
    )


def artist_xml_rows(nested: DataFrame) -> DataFrame:
    def section(kind: str) -> Column:
        held = F.filter("relations", lambda r: r["kind"] == kind)
        names = F.transform(
            held, lambda r: F.struct(r["id"].cast("string").alias("_id"), r["name"].alias("_VALUE"))
        )
        return F.struct(names.alias("name"))

    return nested.select(
        F.col("id").cast("string").alias("id"),
        "name",
        F.col("real_name").alias("realname"),
        "profile",
        F.struct(F.col("urls").alias("url")).alias("urls"),
        section("alias").alias("aliases"),
        section("member").alias("members"),
        section("group").alias("groups"),
    )


def label_xml_rows(nested: DataFrame) -> DataFrame:
    return nested.select(
        F.col("id").cast("string").alias("id"),
        "name",
        "profile",
        F.struct(F.col("urls").alias("url")).alias("urls"),
    )
