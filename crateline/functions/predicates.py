"""Scalar column predicates: seed rule, role markers, placeholders, grades, wording."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from crateline.config import GRADE_ORDER, Grades, SeedRule


# White space of every kind, not only blanks.
WHITE_SPACE = "\t\n\v\f\r \u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B)))


def lit_array(values: Sequence, kind: str = "string") -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def _has_any(values: Column, wanted: Sequence[str]) -> Column:
    held = F.coalesce(values, F.array().cast("array<string>"))
    return F.coalesce(F.arrays_overlap(held, lit_array(wanted)), F.lit(False))


def seed_decision(
    disqualified: Column, core: Column, gated: Column, broad: Column, needs: Column, companion: Column
) -> Column:
    """The seed rule over six facts about a release, however they were gathered."""
    return (
        F.when(disqualified, F.lit(False))
        .when(core, F.lit(True))
        .when(~gated, F.lit(False))
        .otherwise(broad | (needs & companion))
    )


def is_seed_release(styles: Column, genres: Column, rule: SeedRule = SeedRule()) -> Column:
    return seed_decision(
        _has_any(styles, rule.disqualifying),
        _has_any(styles, rule.core),
        _has_any(genres, rule.gate_genres),
        _has_any(styles, rule.broad),
        _has_any(styles, rule.needs_companion),
        _has_any(styles, rule.companions),
    )


def contains_marker(role: Column, markers: Sequence[str]) -> Column:
    """Lower-cased role holds any marker; a null role holds none."""
    lowered = F.lower(role)
    hits = [lowered.contains(m) for m in markers]
    return F.coalesce(reduce(lambda a, b: a | b, hits, F.lit(False)), F.lit(False))


def is_packaging_role(role: Column, markers: Sequence[str]) -> Column:
    return contains_marker(role, markers)


def is_authorship_role(role: Column, markers: Sequence[str]) -> Column:
    return contains_marker(role, markers)


def is_placeholder_artist(
    artist_id: Column, name: Column, ids: Sequence[int], names: Sequence[str]
) -> Column:
    trimmed = F.trim(name, F.lit(WHITE_SPACE))
    return (
        (artist_id <= 0)
        | artist_id.isin(list(ids))
        | F.coalesce(trimmed.isin(list(names)), F.lit(False))
    )


def is_placeholder_label(name: Column, prefix: str) -> Column:
    trimmed = F.lower(F.ltrim(name, F.lit(WHITE_SPACE)))
    return F.coalesce(trimmed.startswith(prefix), F.lit(False))


def not_a_listed_stand_in(
    artist_id: Column, name: Column, ids: Sequence[int], names: Sequence[str]
) -> Column:
    """Kept by the top lists: neither an excluded id nor an excluded name."""
    return ~artist_id.isin(list(ids)) & ~name.isin(list(names))


def usable_label(label_id: Column, name: Column, prefix: str) -> Column:
    return label_id.isNotNull() & ~is_placeholder_label(name, prefix)


def parse_year(raw: Column) -> Column:
    digits = F.regexp_extract(raw, r"(?U)^\s*([0-9]{4})", 1)
    year = digits.try_cast("int")
    return F.when(year >= 1000, year)


def connection(channel_a: Column, channel_b: Column) -> Column:
    return (
        F.when(channel_a & channel_b, "collaborator + label mate")
        .when(channel_a, "collaborator")
        .when(channel_b, "label mate")
    )


def route(channel_a: Column, channel_b: Column) -> Column:
    """The same connection as a profile words it; with neither channel it names both."""
    return (
        F.when(channel_a & channel_b, "an occasional collaborator and label mate")
        .when(channel_a, "an occasional collaborator")
        .when(channel_b, "an occasional label mate")
        .otherwise("an occasional collaborator or label mate")
    )


def grade_artist(seed_releases: Column, share: Column, g: Grades = Grades()) -> Column:
    """A null share fails every comparison, so such an artist goes by volume alone."""
    return (
        F.when(seed_releases.isNull() | (seed_releases < 1), "none")
        .when((seed_releases >= g.high_min_releases) & (share >= g.high_min_share), "high")
        .when(seed_releases >= g.medium_or_releases, "medium")
        .when((seed_releases >= g.medium_min_releases) & (share >= g.medium_min_share), "medium")
        .otherwise("low")
    )


def grade_label(seeds: Column, total: Column, g: Grades = Grades()) -> Column:
    ratio = seeds / F.nullif(total, F.lit(0))
    return (
        F.when(F.coalesce(seeds, F.lit(0)) == 0, "none")
        .when((seeds >= g.label_high_min_artists) & (ratio >= g.label_high_min_ratio), "high")
        .when((seeds >= g.label_medium_min_artists) & (ratio >= g.label_medium_min_ratio), "medium")
        .otherwise("low")
    )


def absence_status(release_count: Column, credited: Column, collaborators: Column) -> Column:
    return (
        F.when(collaborators > 0, "has collaborators")
        .when(release_count == 0, "no releases")
        .when(credited == 0, "no credits recorded")
        .otherwise("worked alone")
    )


def is_imprint(release_count: Column, top_artist_releases: Column) -> Column:
    return F.coalesce(
        (release_count > 1) & (top_artist_releases == release_count), F.lit(False)
    )


def lifted(lineage: Column, relevance: Column, scene_relevance: Column) -> Column:
    return lineage.isNotNull() & (relevance != scene_relevance)


def grade_rank(grade: Column) -> Column:
    ranked = F.when(F.lit(False), F.lit(0))
    for rank, name in enumerate(GRADE_ORDER):
        ranked = ranked.when(grade == name, F.lit(rank))
    return ranked.otherwise(F.lit(len(GRADE_ORDER) - 1))


def share_percent(share: Column) -> Column:
    """Rounds half up; a share that is there but rounds to nothing reads "<1%"."""
    pct = F.floor(share * 100 + 0.5)
    return F.when((pct == 0) & (share > 0), "<1%").otherwise(
        F.concat(pct.cast("string"), F.lit("%"))
    )


def year_span(first: Column, last: Column) -> Column:
    """Missing ends, including a zero year on both sides, leave nothing to say."""
    nothing = (F.coalesce(first, F.lit(0)) == 0) & (F.coalesce(last, F.lit(0)) == 0)
    end = lambda y: F.coalesce(y.cast("string"), F.lit("?"))
    return (
        F.when(nothing, "")
        .when(first.eqNullSafe(last), first.cast("string"))
        .otherwise(F.concat(end(first), F.lit(" – "), end(last)))
    )


def count_line(parts: Column) -> Column:
    """array<struct<n, noun>> to "43 collaborators, 12 labels and 96 releases"."""
    said = F.transform(
        F.filter(parts, lambda p: p["n"] > 0),
        lambda p: F.concat(
            F.format_number(p["n"], 0),
            F.lit(" "),
            p["noun"],
            F.when(p["n"] == 1, "").otherwise("s"),
        ),
    )
    size = F.size(said)
    return F.when(size == 1, said[0]).when(
        size > 1,
        F.concat(
            F.array_join(F.slice(said, F.lit(1), size - 1), ", "),
            F.lit(" and "),
            F.element_at(said, -1),
        ),
    )
