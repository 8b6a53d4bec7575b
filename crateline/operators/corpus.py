"""Corpus selection: a tag-based seed, then one hop over shared credits and shared labels.

Everything works on the flat catalogue tables. Tallies are aggregated before they are
joined, so a person or label on a third of all rows travels as partial counts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crateline.config import Dials, SeedRule
from crateline.functions import predicates as P
from crateline.operators import relational as R


@dataclass(frozen=True)
class Catalogue:
    """Flat catalogue tables, one row per reference.

    releases(id, title, year[, is_seed]), line(release_id, position, artist_id, name,
    join_phrase), credits(release_id, position, artist_id, name, role),
    label_refs(release_id, position, label_id, name, catno), styles(release_id, style),
    genres(release_id, genre). ``nested`` holds the records they were exploded from, if any;
    ``people`` holds the rows of ``appearances``, where one table has both line and credits.
    """

    releases: DataFrame
    line: DataFrame
    credits: DataFrame
    label_refs: DataFrame
    styles: DataFrame
    genres: DataFrame
    nested: DataFrame | None = None
    people: DataFrame | None = None

    def within(self, releases: DataFrame) -> "Catalogue":
        """The rows of the given releases, which also replace the release table.

        Nested records are met once and exploded after, rather than one join per table.
        """
        if self.nested is not None:
            kept = self.nested.join(releases.select("id"), "id", "left_semi")
            return replace(flatten(kept), releases=releases)
        ids = releases.select(F.col("id").alias("release_id"))
        keep = lambda df: df.join(ids, "release_id", "left_semi")
        return replace(
            self,
            releases=releases,
            line=keep(self.line),
            credits=keep(self.credits),
            label_refs=keep(self.label_refs),
            styles=keep(self.styles),
            genres=keep(self.genres),
            people=None if self.people is None else keep(self.people),
        )


def flatten(
    nested: DataFrame,
    is_seed: Callable[[Column, Column], Column] | None = None,
) -> Catalogue:
    """Nested release records to flat tables, keeping each reference's original position.

    ``is_seed`` replaces the seed rule with any predicate over (styles, genres).
    """
    extra = [] if is_seed is None else [is_seed(F.col("styles"), F.col("genres")).alias("is_seed")]

    def exploded(array: str, *fields: str) -> DataFrame:
        rows = nested.select(F.col("id").alias("release_id"), F.posexplode(array))
        return rows.select(
            "release_id", F.col("pos").alias("position"), *[F.col(f"col.{f}").alias(f) for f in fields]
        )

    def tags(array: str, name: str) -> DataFrame:
        return nested.select(
            F.col("id").alias("release_id"), F.explode(F.array_distinct(array)).alias(name)
        )

    people = lambda df: df.withColumnRenamed("id", "artist_id")
    return Catalogue(
        releases=nested.select("id", "title", "year", *extra),
        line=people(exploded("artists", "id", "name", "join_phrase")),
        credits=people(exploded("credits", "id", "name", "role")),
        label_refs=exploded("labels", "id", "name", "catno").withColumnRenamed("id", "label_id"),
        styles=tags("styles", "style"),
        genres=tags("genres", "genre"),
        nested=nested,
    )


def from_records(nested: DataFrame, rule: SeedRule = SeedRule()) -> Catalogue:
    """Nested records whose seed decision is taken within the record, with no shuffle."""
    return flatten(nested, lambda styles, genres: P.is_seed_release(styles, genres, rule))


def appearances(cat: Catalogue) -> DataFrame:
    """(release_id, artist_id, name, role): the line with a null role, and every credit."""
    if cat.people is not None:
        return cat.people
    line = cat.line.select(
        "release_id", "artist_id", "name", F.lit(None).cast("string").alias("role")
    )
    return line.unionByName(cat.credits.select("release_id", "artist_id", "name", "role"))


def without_placeholders(people: DataFrame, dials: Dials) -> DataFrame:
    return people.filter(
        ~P.is_placeholder_artist(
            F.col("artist_id"), F.col("name"), dials.placeholder_ids, dials.placeholder_names
        )
    )


def usable_label_refs(label_refs: DataFrame, dials: Dials) -> DataFrame:
    return label_refs.filter(
        P.usable_label(F.col("label_id"), F.col("name"), dials.placeholder_label_prefix)
    )


def label_ref_measures(dials: Dials) -> dict[str, Column]:
    """References without an id, and placeholders among the rest, over reference rows."""
    no_id = F.col("label_id").isNull()
    placeholder = P.is_placeholder_label(F.col("name"), dials.placeholder_label_prefix)
    return {
        "labels_without_id": F.count_if(no_id),
        "placeholder_labels": F.count_if(~no_id & placeholder),
    }


def record_label_measures(dials: Dials) -> dict[str, Column]:
    """The same over nested records, counted within each."""
    placeholder = lambda l: P.is_placeholder_label(l["name"], dials.placeholder_label_prefix)
    held = lambda test: F.sum(F.size(F.filter("labels", test)))
    return {
        "labels_without_id": held(lambda l: l["id"].isNull()),
        "placeholder_labels": held(lambda l: l["id"].isNotNull() & placeholder(l)),
    }


def label_ref_stats(label_refs: DataFrame, dials: Dials) -> DataFrame:
    """One row: references without an id, placeholders among the rest, usable ones."""
    stats = label_refs.agg(F.count("*").alias("refs"), *[m.alias(name) for name, m in label_ref_measures(dials).items()])
    usable = F.col("refs") - F.col("labels_without_id") - F.col("placeholder_labels")
    return stats.withColumn("usable_labels", usable).drop("refs")


# --- seed -------------------------------------------------------------------------


def label_artist_pairs(cat: Catalogue, dials: Dials) -> DataFrame:
    """Distinct (label_id, artist_id) over every release, line artists only.

    In nested records labels meet artists within the record, and the pairs are shuffled once.
    """
    if cat.nested is not None:
        usable = lambda l: P.usable_label(l["id"], l["name"], dials.placeholder_label_prefix)
        placeholder = lambda a: P.is_placeholder_artist(
            a["id"], a["name"], dials.placeholder_ids, dials.placeholder_names
        )
        ids = lambda people: F.array_distinct(F.transform(people, lambda p: p["id"]))
        labels = ids(F.filter("labels", usable))
        artists = ids(F.filter("artists", lambda a: ~placeholder(a)))
        met = cat.nested.select(F.explode(labels).alias("label_id"), artists.alias("artists"))
        return met.select("label_id", F.explode("artists").alias("artist_id")).distinct()
    labels = usable_label_refs(cat.label_refs, dials).select("release_id", "label_id")
    artists = without_placeholders(cat.line, dials).select("release_id", "artist_id")
    return labels.join(artists, "release_id").select("label_id", "artist_id").distinct()


def seed_releases(cat: Catalogue, rule: SeedRule = SeedRule()) -> DataFrame:
    """Releases the seed rule admits, decided from per-release tag facts, never a tag list.

    Facts of styles and of genres are joined, so tables dealt by release meet without a shuffle.
    """
    if "is_seed" in cat.releases.columns:
        return cat.releases.filter("is_seed").drop("is_seed")
    wanted = {
        "disqualified": rule.disqualifying,
        "core": rule.core,
        "broad": rule.broad,
        "needs": rule.needs_companion,
        "companion": rule.companions,
    }
    listed = sorted({style for styles in wanted.values() for style in styles})
    by_style = (
        cat.styles.filter(F.col("style").isin(listed))
        .groupBy("release_id")
        .agg(*[F.bool_or(F.col("style").isin(list(styles))).alias(name) for name, styles in wanted.items()])
    )
    by_genre = cat.genres.filter(F.col("genre").isin(list(rule.gate_genres))).groupBy("release_id").agg(
        F.lit(True).alias("gated")
    )
    facts = cat.releases
    for found in (by_style, by_genre):
        facts = facts.join(found.withColumnRenamed("release_id", "id"), "id", "left")
    fact = lambda name: F.coalesce(name, F.lit(False))
    admitted = facts.filter(
        P.seed_decision(*[fact(n) for n in ("disqualified", "core", "gated", "broad", "needs", "companion")])
    )
    return admitted.select(*cat.releases.columns)


def seed_appearances(cat: Catalogue, seeds: DataFrame) -> DataFrame:
    return appearances(cat).join(
        seeds.select(F.col("id").alias("release_id")), "release_id", "left_semi"
    )


def seed_artist_tally(seed_people: DataFrame, dials: Dials) -> DataFrame:
    """(artist_id, seed_releases): appearances, so line and credit on one release count twice."""
    musical = seed_people.filter(~P.is_packaging_role(F.col("role"), dials.packaging_roles))
    return without_placeholders(musical, dials).groupBy("artist_id").agg(
        F.count("*").alias("seed_releases")
    )


def appearance_counts(people: DataFrame) -> DataFrame:
    """(artist_id, total): appearances over the whole catalogue, everyone counted."""
    return people.groupBy("artist_id").agg(F.count("*").alias("total"))


def artist_totals(people: DataFrame, ids: DataFrame) -> DataFrame:
    """(artist_id, total) of the given ids: counted first, then restricted."""
    return R.semi_join(appearance_counts(people), ids, "artist_id")


def seed_artists(tally: DataFrame, totals: DataFrame, min_ratio: float | None) -> DataFrame:
    """(artist_id, seed_releases, total_releases) with enough of their work in the seed."""
    if min_ratio is None:
        return tally.withColumn("total_releases", F.lit(None).cast("bigint"))
    measured = tally.join(totals, "artist_id", "left")
    whole = F.greatest(F.lit(1), F.coalesce("total", "seed_releases"))
    return measured.filter(F.col("seed_releases") / whole >= min_ratio).select(
        "artist_id", "seed_releases", F.col("total").alias("total_releases")
    )


def label_seed_counts(pairs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(label_id, seeds, total) over the roster pairs."""
    marked = pairs.join(
        seeds.select("artist_id", F.lit(1).alias("_seed")), "artist_id", "left"
    )
    return marked.groupBy("label_id").agg(
        F.count("_seed").alias("seeds"), F.count("*").alias("total")
    )


def seed_labels(
    pairs: DataFrame,
    seeds: DataFrame,
    min_artists: int,
    min_ratio: float,
    seen: Callable[[DataFrame], DataFrame] = lambda rosters: rosters,
) -> DataFrame:
    """Labels with enough seed artists; ``seen`` may watch the counts of all labels."""
    ratio = F.col("seeds") / F.col("total")
    return (
        seen(label_seed_counts(pairs, seeds))
        .filter((F.col("seeds") >= min_artists) & (ratio >= min_ratio))
        .select(
            "label_id",
            F.col("seeds").alias("seed_artist_count"),
            F.col("total").alias("total_artist_count"),
            ratio.alias("seed_ratio"),
        )
    )


def candidate_labels(pairs: DataFrame, seeds: DataFrame) -> DataFrame:
    """One row: labels with at least one seed artist."""
    return pairs.join(seeds.select("artist_id"), "artist_id", "left_semi").agg(
        F.countDistinct("label_id").alias("candidate_labels")
    )


def roles_seen(credits: DataFrame) -> DataFrame:
    """(role, occurrences), raw strings, every credit of the corpus counted once."""
    return R.count_by_key(credits, "role")


# --- one hop ----------------------------------------------------------------------


def bridges(seeds: DataFrame, totals: DataFrame, min_ratio: float | None) -> DataFrame:
    """Seed artists who may vouch for a release; one never counted stays a bridge."""
    if min_ratio is None:
        return seeds.select("artist_id")
    measured = seeds.select("artist_id", "seed_releases").join(totals, "artist_id", "left")
    share = F.col("seed_releases") / F.greatest(F.lit(1), F.col("total"))
    return measured.filter(F.col("total").isNull() | (share >= min_ratio)).select("artist_id")


def channel_flags(
    people: DataFrame,
    label_refs: DataFrame,
    bridging: DataFrame,
    labels: DataFrame,
    dials: Dials,
) -> DataFrame:
    """(release_id, channel_a, channel_b) for releases on either channel."""
    by_person = (
        without_placeholders(people, dials)
        .select("release_id", "artist_id")
        .join(bridging.select("artist_id"), "artist_id", "left_semi")
        .select("release_id", F.lit(True).alias("channel_a"), F.lit(False).alias("channel_b"))
    )
    by_label = (
        usable_label_refs(label_refs, dials)
        .select("release_id", "label_id")
        .join(labels.select("label_id"), "label_id", "left_semi")
        .select("release_id", F.lit(False).alias("channel_a"), F.lit(True).alias("channel_b"))
    )
    return (
        by_person.unionByName(by_label)
        .groupBy("release_id")
        .agg(F.max("channel_a").alias("channel_a"), F.max("channel_b").alias("channel_b"))
    )


def kept_releases(releases: DataFrame, seeds: DataFrame, flags: DataFrame) -> DataFrame:
    """Seed releases and kept releases; a seed release on neither channel stays, flags off.

    ``R.merge_flags`` by joins, since tables dealt by release meet in them without a shuffle.
    """
    is_seed = F.coalesce("is_seed", F.lit(False))
    names = ("channel_a", "channel_b")
    seed = seeds.select("id").distinct().withColumn("is_seed", F.lit(True))
    found = flags.groupBy(F.col("release_id").alias("id")).agg(F.lit(True).alias("on"), *[F.max(n).alias(n) for n in names])
    both = releases.select("id", "title", "year").join(seed, "id", "left").join(found, "id", "left")
    off = lambda name: F.when(is_seed, F.coalesce(name, F.lit(False))).otherwise(F.col(name))
    return both.filter(is_seed | F.coalesce("on", F.lit(False))).select(
        "id", "title", "year", is_seed.alias("is_seed"), *[off(n).alias(n) for n in names]
    )


def admissible_people(people: DataFrame, dials: Dials) -> DataFrame:
    """Appearances that may bring a person in: writing a piece is not making a record."""
    return without_placeholders(people, dials).filter(
        ~P.is_authorship_role(F.col("role"), dials.authorship_roles)
    )


def crowded(admissible: DataFrame, max_people: int) -> DataFrame:
    """(release_id, crowded) by admissible appearances, not distinct people."""
    return admissible.groupBy("release_id").agg((F.count("*") > max_people).alias("crowded"))


def ties_and_label_mates(
    admissible: DataFrame,
    flags: DataFrame,
    crowds: DataFrame,
    seen: Callable[[DataFrame], DataFrame] = lambda releases: releases,
) -> DataFrame:
    """(artist_id, ties_a, via_b) over kept releases; crowded ones tie nobody. ``seen`` may watch
    the releases on a channel, beside whether they are crowded."""
    release = seen(flags.join(crowds, "release_id", "left")).select(
        "release_id",
        (F.col("channel_a") & ~F.coalesce("crowded", F.lit(False))).alias("ties"),
        "channel_b",
    )
    return (
        admissible.select("release_id", "artist_id")
        .join(release, "release_id")
        .groupBy("artist_id")
        .agg(F.count_if("ties").alias("ties_a"), F.max("channel_b").alias("via_b"))
    )


def corpus_artists(seeds: DataFrame, ties: DataFrame, min_ties: int) -> DataFrame:
    """(artist_id, is_seed, channel_a, channel_b) for seed artists and whom the hop admits."""
    rows = seeds.select(
        "artist_id",
        F.lit(True).alias("is_seed"),
        F.lit(0).cast("bigint").alias("ties_a"),
        F.lit(False).alias("via_b"),
    ).unionByName(ties.select("artist_id", F.lit(False).alias("is_seed"), "ties_a", "via_b"))
    merged = rows.groupBy("artist_id").agg(
        F.max("is_seed").alias("is_seed"), F.max("ties_a").alias("ties_a"), F.max("via_b").alias("via_b")
    )
    enough = F.col("is_seed") | (F.col("ties_a") >= min_ties)
    return merged.select(
        "artist_id",
        "is_seed",
        ((F.col("ties_a") > 0) & enough).alias("channel_a"),
        F.col("via_b").alias("channel_b"),
    ).filter(F.col("is_seed") | F.col("channel_a") | F.col("channel_b"))


# --- reports ----------------------------------------------------------------------


def pass1_stats(
    cat: Catalogue,
    seeds: DataFrame,
    seed_people: DataFrame,
    tally: DataFrame,
    kept_artists: DataFrame,
    pairs: DataFrame,
    labels: DataFrame,
    dials: Dials,
) -> DataFrame:
    packaging = P.is_packaging_role(F.col("role"), dials.packaging_roles)
    stats = R.one_row(
        R.row_count(cat.releases, "scanned"),
        R.row_count(seeds, "seed_releases"),
        R.row_count(kept_artists, "seed_artists"),
        candidate_labels(pairs, kept_artists),
        R.row_count(labels, "seed_labels"),
        seed_people.agg(
            F.countDistinct("role").alias("distinct_roles"),
            F.count_if(packaging).alias("packaging_credits"),
        ),
        label_ref_stats(cat.label_refs, dials).drop("usable_labels"),
        R.row_count(tally, "seed_candidates"),
    )
    return stats.withColumn("dropped_by_ratio", F.col("seed_candidates") - F.col("seed_artists"))


def pass2_stats(
    releases: DataFrame,
    flags: DataFrame,
    crowds: DataFrame,
    seeds: DataFrame,
    bridging: DataFrame,
    members: DataFrame,
) -> DataFrame:
    """One row of channel counts with their percentages, people counts and guards."""
    a, b = F.col("channel_a"), F.col("channel_b")
    kept = flags.join(crowds, "release_id", "left").agg(
        F.count_if(a & ~b).alias("kept_a"),
        F.count_if(b & ~a).alias("kept_b"),
        F.count_if(a & b).alias("kept_both"),
        F.count("*").alias("total_kept"),
        F.count_if("crowded").alias("crowded_releases"),
    )
    people = members.agg(
        F.count("*").alias("corpus_artists"), F.count_if(~F.col("is_seed")).alias("new_artists")
    )
    stats = R.one_row(
        R.row_count(releases, "scanned"),
        kept,
        people,
        R.row_count(seeds, "seed_artists"),
        R.row_count(bridging, "bridging_artists"),
    )
    share = lambda name: 100 * F.col(name) / F.nullif(F.col("total_kept"), F.lit(0))
    return stats.select(
        "*",
        (F.col("seed_artists") - F.col("bridging_artists")).alias("suppressed_bridges"),
        share("kept_a").alias("pct_a"),
        share("kept_b").alias("pct_b"),
        share("kept_both").alias("pct_both"),
    ).drop("bridging_artists")
