"""Small catalogues made by hand."""

from __future__ import annotations

from crateline.operators.corpus import Catalogue, flatten

NESTED = (
    "id bigint, title string, year int, artists array<struct<id:bigint,name:string,join_phrase:string>>, "
    "credits array<struct<id:bigint,name:string,role:string>>, "
    "labels array<struct<id:bigint,name:string,catno:string>>, styles array<string>, genres array<string>"
)


def nested(spark, *releases: dict):
    """Releases as dicts: artists are ids, credits (id, role), labels ids or (id, name)."""
    rows = []
    for r in releases:
        person = lambda p: p if isinstance(p, tuple) else (p, f"Artist {p}")
        artists = [(*person(p), None) for p in r.get("artists", [])]
        credits = [(i, f"Artist {i}", role) for i, role in r.get("credits", [])]
        labels = [
            (*(l if isinstance(l, tuple) else (l, f"Label {l}")), None) for l in r.get("labels", [])
        ]
        rows.append(
            (
                r["id"], f"Release {r['id']}", r.get("year"), artists, credits, labels,
                r.get("styles", []), r.get("genres", []),
            )
        )
    return spark.createDataFrame(rows, NESTED)


def catalogue(spark, *releases: dict, is_seed=None) -> Catalogue:
    return flatten(nested(spark, *releases), is_seed)


def corpus(spark, *releases: dict) -> dict:
    """Derive inputs: everyone named is a corpus artist, every release seeded unless told."""
    from pyspark.sql import functions as F

    cat = catalogue(spark, *releases)
    unseeded = [r["id"] for r in releases if r.get("seed") is False]
    everyone = cat.line.select("artist_id").union(cat.credits.select("artist_id")).distinct()
    flag = F.lit(True) if not unseeded else ~F.col("id").isin(unseeded)
    return {
        "releases": cat.releases.withColumn("is_seed", flag),
        "release_artists": cat.line,
        "release_credits": cat.credits,
        "release_labels": cat.label_refs,
        "release_styles": cat.styles,
        "release_genres": cat.genres,
        "corpus_artists": everyone.select(
            "artist_id", F.lit(True).alias("is_seed"), F.lit(False).alias("channel_a"), F.lit(False).alias("channel_b")
        ),
        "label_artist_pairs": cat.label_refs.join(cat.line.select("release_id", "artist_id"), "release_id")
        .select("label_id", "artist_id")
        .distinct(),
        "labels": cat.label_refs.select(F.col("label_id").alias("id"), "name").distinct(),
        "seed_artists": spark.createDataFrame([], "artist_id bigint, seed_releases bigint, total_releases bigint"),
        "seed_artist_totals": spark.createDataFrame([], "artist_id bigint, total bigint"),
    }


def values(df, *columns):
    """Rows as a sorted list of tuples, or of plain values for one column."""
    rows = [tuple(r) for r in df.select(*columns).collect()]
    rows = [r[0] for r in rows] if len(columns) == 1 else rows
    return sorted(rows, key=lambda v: str(v))
