"""The ranked answers: pairs, rosters, coverage, lineage and grades."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crateline.config import LIFTS_FROM, Grades, Tradition
from crateline.functions import predicates as P
from crateline.operators import corpus as C
from crateline.operators import relational as R

# --- people and pairs ---------------------------------------------------------------


def release_people(line: DataFrame, credits: DataFrame, corpus: DataFrame) -> DataFrame:
    """(release_id, artist_id, role) of corpus artists; a null role is the line."""
    on_line = line.select("release_id", "artist_id", F.lit(None).cast("string").alias("role"))
    credited = credits.select("release_id", "artist_id", "role")
    return R.semi_join(on_line.unionByName(credited), corpus, "artist_id")


def people_once(people: DataFrame) -> DataFrame:
    """(release_id, artist_id, roles): each person of a release once, with their distinct raw roles.

    Every distinct count downstream starts from it; operators that take ``once`` expect this table,
    so it is worked out a single time. Roles are packed per person, not per release, so no task
    meets all of a large release.
    """
    return people.groupBy("release_id", "artist_id").agg(F.collect_set("role").alias("roles"))


def pairable(once: DataFrame, max_people: int) -> DataFrame:
    return (
        once.groupBy("release_id")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") <= max_people)
        .select("release_id")
    )


def releases_skipped(releases: DataFrame, pairs_from: DataFrame) -> DataFrame:
    counts = R.one_row(R.row_count(releases, "releases"), R.row_count(pairs_from, "pairable"))
    return counts.select((F.col("releases") - F.col("pairable")).alias("releases_skipped"))


def pair_counts(people: DataFrame, max_people: int) -> DataFrame:
    """(aid, bid, n): releases two people share, both directions."""
    shared = R.people_who_share(people, "release_id", "artist_id", max_people)
    return shared.groupBy(F.col("a").alias("aid"), F.col("b").alias("bid")).agg(
        F.count("*").alias("n")
    )


def groups_of_people(once: DataFrame, max_people: int) -> DataFrame:
    """(release_id, members): people with their roles, of releases with at most ``max_people``.

    People are cut together with their roles on the map side, at most one more than the dial per
    task and release, so a large release sends a few rows and a small one loses no role.
    """
    packed = once.select("release_id", F.struct("artist_id", "roles").alias("person"))
    return R.members_within(packed, "release_id", "person", max_people)


def _pairs(groups: DataFrame) -> DataFrame:
    """(aid, bid, roles of b there): one row per pair and release."""
    firsts = groups.filter(F.size("members") > 1).select(F.explode("members.artist_id").alias("aid"), "members")
    both = firsts.select("aid", F.inline("members")).filter(F.col("aid") != F.col("artist_id"))
    return both.select("aid", F.col("artist_id").alias("bid"), "roles")


def _roles() -> Column:
    """Sets of roles are gathered, not roles per release, so what a pair holds is bounded by its answer.

    A release where b held none adds nothing to gather and to send."""
    held = F.when(F.size("roles") > 0, F.col("roles"))
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(held))))


def pair_roles(people: DataFrame, max_people: int, once: DataFrame | None = None) -> DataFrame:
    """(aid, bid, roles): distinct raw roles b held, sorted. Pairs with none have no row."""
    groups = groups_of_people(people_once(people) if once is None else once, max_people)
    held = _pairs(groups).filter(F.size("roles") > 0)
    return held.groupBy("aid", "bid").agg(_roles().alias("roles"))


def artist_collaborators(
    people: DataFrame,
    max_people: int,
    once: DataFrame | None = None,
    seen: Callable[[DataFrame], DataFrame] = lambda groups: groups,
) -> DataFrame:
    """Shared releases and roles per pair, by one aggregation; ``seen`` may watch the releases paired."""
    groups = seen(groups_of_people(people_once(people) if once is None else once, max_people))
    return (
        _pairs(groups)
        .groupBy(F.col("aid").alias("artist_id"), F.col("bid").alias("collaborator_id"))
        .agg(F.count("*").alias("shared_releases"), _roles().alias("roles"))
        .withColumn("roles", F.when(F.size("roles") > 0, F.col("roles")))
    )


# --- labels -------------------------------------------------------------------------


def artist_labels(once: DataFrame, label_refs: DataFrame, releases: DataFrame) -> DataFrame:
    """(artist_id, label_id, release_count, first_year, last_year), every release counted."""
    on_label = (
        label_refs.select("release_id", "label_id")
        .distinct()
        .join(releases.select(F.col("id").alias("release_id"), "year"), "release_id")
    )
    return (
        once.join(on_label, "release_id")
        .groupBy("artist_id", "label_id")
        .agg(
            F.count("*").alias("release_count"),
            F.min("year").alias("first_year"),
            F.max("year").alias("last_year"),
        )
    )


def label_roster(by_artist: DataFrame) -> DataFrame:
    return by_artist.select("label_id", "artist_id", "release_count", "first_year", "last_year")


# --- coverage -----------------------------------------------------------------------


def release_facts(releases: DataFrame, credits: DataFrame) -> DataFrame:
    """(release_id, year, is_seed, credited): one row per release."""
    credited = credits.select("release_id").distinct().withColumn("credited", F.lit(True))
    return (
        releases.select(F.col("id").alias("release_id"), "year", "is_seed")
        .join(credited, "release_id", "left")
        .withColumn("credited", F.coalesce("credited", F.lit(False)))
    )


def coverage_counts(once: DataFrame, releases: DataFrame, credits: DataFrame) -> DataFrame:
    """Per artist: releases, those with any credit, seed releases and the year span.

    People come once per release, so plain counts are distinct counts and one pass serves
    every measure.
    """
    return (
        once.join(release_facts(releases, credits), "release_id")
        .groupBy("artist_id")
        .agg(
            F.count("*").alias("release_count"),
            F.count_if("credited").alias("credited_releases"),
            F.count_if("is_seed").alias("seed_n"),
            F.min("year").alias("first_year"),
            F.max("year").alias("last_year"),
        )
    )


def rows_per_artist(derived: DataFrame, name: str = "n") -> DataFrame:
    return derived.groupBy("artist_id").agg(F.count("*").alias(name))


def seed_counts(once: DataFrame, releases: DataFrame) -> DataFrame:
    """(artist_id, n): distinct seed releases of every corpus artist."""
    seeds = releases.filter("is_seed").select(F.col("id").alias("release_id"))
    return once.join(seeds, "release_id", "left_semi").groupBy("artist_id").agg(
        F.count("*").alias("n")
    )


# --- lineage ------------------------------------------------------------------------


def tag_matches(
    styles: DataFrame, genres: DataFrame, rules: Sequence[Tradition]
) -> DataFrame:
    """(release_id, rule): releases matching each tag rule, all rules in one pass."""
    spark = styles.sparkSession
    numbered = [(i, r) for i, r in enumerate(rules) if r.styles or r.genre]
    # The rule lists are parameters, so broadcasting them is bounded.
    by_style = R.literal_rows(
        spark, [("style", "string"), ("rule", "int")], [(s, i) for i, r in numbered for s in r.styles]
    )
    by_genre = R.literal_rows(
        spark, [("genre", "string"), ("rule", "int")], [(r.genre, i) for i, r in numbered if r.genre]
    )
    needs = R.literal_rows(
        spark,
        [("rule", "int"), ("needs_style", "boolean"), ("needs_genre", "boolean")],
        [(i, bool(r.styles), r.genre is not None) for i, r in numbered],
    )
    hits = (
        styles.join(F.broadcast(by_style), "style")
        .select("release_id", "rule", F.lit(True).alias("style"), F.lit(False).alias("genre"))
        .unionByName(
            genres.join(F.broadcast(by_genre), "genre").select(
                "release_id", "rule", F.lit(False).alias("style"), F.lit(True).alias("genre")
            )
        )
    )
    found = hits.groupBy("release_id", "rule").agg(
        F.max("style").alias("style"), F.max("genre").alias("genre")
    )
    return (
        found.join(F.broadcast(needs), "rule")
        .filter((F.col("style") | ~F.col("needs_style")) & (F.col("genre") | ~F.col("needs_genre")))
        .select("release_id", "rule")
    )


def label_matches(label_refs: DataFrame, rules: Sequence[Tradition]) -> DataFrame:
    """(release_id, rule): releases on each rule's labels."""
    listed = R.literal_rows(
        label_refs.sparkSession,
        [("label_id", "bigint"), ("rule", "int")],
        [(label, i) for i, r in enumerate(rules) for label in r.labels],
    )
    return (
        label_refs.join(F.broadcast(listed), "label_id").select("release_id", "rule").distinct()
    )


def lineage_candidates(
    once: DataFrame, matches: DataFrame, coverage: DataFrame, rules: Sequence[Tradition]
) -> DataFrame:
    """(artist_id, rule, n): artists clearing a rule's floor and share."""
    dials = R.literal_rows(
        once.sparkSession,
        [("rule", "int"), ("min_releases", "int"), ("min_share", "double")],
        [(i, r.min_releases, r.min_share) for i, r in enumerate(rules)],
    )
    counted = (
        once.join(matches, "release_id")
        .groupBy("artist_id", "rule")
        .agg(F.count("*").alias("n"))
        .join(F.broadcast(dials), "rule")
        .filter(F.col("n") >= F.col("min_releases"))
    )
    return (
        counted.join(coverage.select("artist_id", "release_count"), "artist_id")
        .filter(F.col("n") / F.col("release_count") >= F.col("min_share"))
        .select("artist_id", "rule", "n")
    )


def rule_names(candidates: DataFrame, rules: Sequence[Tradition]) -> DataFrame:
    """(artist_id, rule) with the rule's name in place of its number."""
    return candidates.select("artist_id", _rule_name(rules).alias("rule"))


def _rule_name(rules: Sequence[Tradition]):
    return P.lit_array([r.name for r in rules])[F.col("rule")]


def lineage_tags(candidates: DataFrame, rules: Sequence[Tradition]) -> DataFrame:
    """(artist_id, lineage): the first rule in precedence order."""
    first = candidates.groupBy("artist_id").agg(F.min("rule").alias("rule"))
    return first.select("artist_id", _rule_name(rules).alias("lineage"))


# --- artist coverage ----------------------------------------------------------------


def artist_coverage(
    corpus: DataFrame,
    coverage: DataFrame,
    collaborators: DataFrame,
    labels: DataFrame,
    lineage: DataFrame,
    seeds: DataFrame,
    totals: DataFrame,
    grades: Grades = Grades(),
) -> DataFrame:
    """One row per corpus artist with counts, displayed share, measured grade and lineage.

    The grade reads the seed tally; the displayed share reads distinct seed releases.
    """
    facts = R.left_join_all(
        corpus.select("artist_id"),
        [
            coverage,
            rows_per_artist(collaborators, "collab_n"),
            rows_per_artist(labels, "label_n"),
            lineage,
            seeds.select(
                "artist_id",
                F.col("seed_releases").alias("tally"),
                F.col("total_releases").alias("tally_total"),
            ),
            totals.select("artist_id", "total"),
        ],
        "artist_id",
    )
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    share = F.col("tally") / F.nullif(F.col("tally_total"), F.lit(0))
    return facts.select(
        "artist_id",
        zero("release_count").alias("release_count"),
        zero("credited_releases").alias("credited_releases"),
        zero("collab_n").alias("collaborator_count"),
        zero("label_n").alias("label_count"),
        "first_year",
        "last_year",
        zero("seed_n").alias("seed_releases"),
        (zero("seed_n") / F.nullif(F.coalesce("tally_total", "total"), F.lit(0))).alias("seed_share"),
        P.grade_artist(F.col("tally"), share, grades).alias("scene_relevance"),
        P.grade_artist(F.col("tally"), share, grades).alias("relevance"),
        "lineage",
    )


def lineage_floor(
    coverage: DataFrame,
    rules: Sequence[Tradition],
    lifts_from: dict[str, Sequence[str]] = LIFTS_FROM,
) -> DataFrame:
    """A tradition lifts the grade to its floor from the grades that floor may lift."""
    lifted = F.when(F.lit(False), F.col("relevance"))
    for rule in rules:
        if rule.floor not in lifts_from:
            raise ValueError(f"tradition {rule.name!r} has no rule for floor {rule.floor!r}")
        below = F.col("relevance").isin(list(lifts_from[rule.floor]))
        lifted = lifted.when((F.col("lineage") == rule.name) & below, F.lit(rule.floor))
    return coverage.withColumn("relevance", lifted.otherwise(F.col("relevance")))


def lineage_summary(coverage: DataFrame) -> DataFrame:
    return (
        coverage.filter(F.col("lineage").isNotNull())
        .groupBy("lineage")
        .agg(
            F.count("*").alias("tagged"),
            F.count_if(F.col("relevance") != F.col("scene_relevance")).alias("lifted"),
        )
        .orderBy(F.col("tagged").desc(), "lineage")
    )


# --- label coverage -----------------------------------------------------------------


def pairs_guard(label_refs: DataFrame, pairs: DataFrame) -> None:
    """Refuse to grade labels against an empty roster: every grade would read as an answer."""
    if pairs.isEmpty() and not label_refs.isEmpty():
        raise ValueError("label_artist_pairs is empty, so no label can be graded")


def label_coverage(
    labels: DataFrame, pairs: DataFrame, seeds: DataFrame, grades: Grades = Grades()
) -> DataFrame:
    counts = C.label_seed_counts(pairs, seeds).withColumnRenamed("label_id", "id")
    graded = labels.select("id").join(counts, "id", "left")
    return graded.select(
        F.col("id").alias("label_id"),
        F.coalesce("total", F.lit(0)).alias("line_artist_count"),
        F.coalesce("seeds", F.lit(0)).alias("seed_artist_count"),
        (F.col("seeds") / F.nullif(F.col("total"), F.lit(0))).alias("seed_ratio"),
        P.grade_label(F.col("seeds"), F.col("total"), grades).alias("relevance"),
    )


def label_grade_histogram(coverage: DataFrame) -> DataFrame:
    return (
        coverage.groupBy("relevance")
        .agg(F.count("*").alias("labels"))
        .orderBy(P.grade_rank(F.col("relevance")))
    )


def derive_stats(
    collaborators: DataFrame,
    by_artist: DataFrame,
    coverage: DataFrame,
    by_label: DataFrame,
    skipped: DataFrame,
) -> DataFrame:
    return R.one_row(
        R.row_count(collaborators, "artist_collaborators"),
        R.row_count(by_artist, "artist_labels"),
        R.row_count(by_artist, "label_roster"),
        R.row_count(coverage, "artist_coverage"),
        R.row_count(by_label, "label_coverage"),
        skipped,
    )
