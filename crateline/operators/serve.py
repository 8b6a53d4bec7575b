"""Ranked answers over the derived tables, for one id or for every entity at once.

With ``id`` given, the id filter reaches the scan. Without it the same limit holds per
entity, by a per-group top-k whose map side already keeps no more than the limit.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crateline.config import (
    KNOWN_HOSTS,
    LINK_LIMIT,
    PAGE_MAX,
    PAGE_SIZE,
    TOP_LIST_SIZE,
    SceneLists,
)
from crateline.functions import predicates as P
from crateline.functions import text as T
from crateline.operators import entities as E
from crateline.operators import relational as R

Tables = Mapping[str, DataFrame]


def _only(df: DataFrame, column: str, id: int | None) -> DataFrame:
    return df if id is None else df.filter(F.col(column) == id)


def _best(df: DataFrame, group: str, order: Sequence[Column], limit: int, id: int | None) -> DataFrame:
    """The limit per entity, with the place each row takes."""
    return R.top_k_per_group(_only(df, group, id), [group], order, limit, rank="place")


def _names(entities: DataFrame, id_column: str) -> DataFrame:
    return entities.select(F.col("id").alias(id_column), "name")


# --- profiles and per-entity lists ----------------------------------------------------


def artist_profile(tables: Tables, id: int | None = None) -> DataFrame:
    coverage = tables["artist_coverage"].withColumnRenamed("artist_id", "id")
    members = tables["corpus_artists"].withColumnRenamed("artist_id", "id")
    joined = (
        _only(tables["artists"], "id", id).join(coverage, "id", "left").join(members, "id", "left")
    )
    count = lambda name: F.coalesce(F.col(name), F.lit(0)).alias(name)
    flag = lambda name: F.coalesce(F.col(name), F.lit(False)).alias(name)
    grade = lambda name: F.coalesce(F.col(name), F.lit("none")).alias(name)
    return joined.select(
        "id",
        "name",
        "real_name",
        "profile",
        F.coalesce("urls", F.array().cast("array<string>")).alias("urls"),
        *[
            count(c)
            for c in ("release_count", "credited_releases", "collaborator_count", "label_count")
        ],
        "first_year",
        "last_year",
        *[flag(c) for c in ("is_seed", "channel_a", "channel_b")],
        grade("relevance"),
        grade("scene_relevance"),
        count("seed_releases"),
        "seed_share",
        "lineage",
    )


def top_collaborators(tables: Tables, id: int | None = None, limit: int = 100) -> DataFrame:
    pairs = _only(tables["artist_collaborators"], "artist_id", id)
    named = pairs.join(_names(tables["artists"], "collaborator_id"), "collaborator_id")
    order = [F.col("shared_releases").desc(), F.col("name"), F.col("collaborator_id")]
    return _best(named, "artist_id", order, limit, id).select(
        "artist_id", "place", "collaborator_id", "name", "shared_releases", "roles"
    )


def ranked_artist_labels(tables: Tables, id: int | None = None) -> DataFrame:
    """Every label of an artist, best first. Unlimited, so a global sort and no window."""
    rows = _only(tables["artist_labels"], "artist_id", id)
    named = rows.join(_names(tables["labels"], "label_id"), "label_id")
    return named.select(
        "artist_id", "label_id", "name", "release_count", "first_year", "last_year"
    ).orderBy("artist_id", F.col("release_count").desc(), "name", "label_id")


def label_profile(tables: Tables, id: int | None = None) -> DataFrame:
    roster = _only(tables["label_roster"], "label_id", id)
    releases = (
        _only(tables["release_labels"], "label_id", id)
        .groupBy("label_id")
        .agg(F.countDistinct("release_id").alias("release_count"))
    )
    joined = R.left_join_all(
        _only(tables["labels"], "id", id).withColumnRenamed("id", "label_id"),
        [
            roster.groupBy("label_id").agg(
                F.count("*").alias("artist_count"),
                F.max("release_count").alias("top_artist_releases"),
                F.min("first_year").alias("first_year"),
                F.max("last_year").alias("last_year"),
            ),
            releases,
            tables["label_coverage"].select("label_id", "relevance", "seed_ratio"),
        ],
        "label_id",
    )
    count = lambda name: F.coalesce(F.col(name), F.lit(0))
    return joined.select(
        F.col("label_id").alias("id"),
        "name",
        "profile",
        F.coalesce("urls", F.array().cast("array<string>")).alias("urls"),
        count("artist_count").alias("artist_count"),
        count("release_count").alias("release_count"),
        F.coalesce("relevance", F.lit("none")).alias("relevance"),
        "seed_ratio",
        P.is_imprint(count("release_count"), F.col("top_artist_releases")).alias("is_imprint"),
        "first_year",
        "last_year",
    )


def top_roster(tables: Tables, id: int | None = None, limit: int = 200) -> DataFrame:
    rows = _only(tables["label_roster"], "label_id", id)
    named = rows.join(_names(tables["artists"], "artist_id"), "artist_id")
    order = [F.col("release_count").desc(), F.col("name"), F.col("artist_id")]
    return _best(named, "label_id", order, limit, id).select(
        "label_id", "place", "artist_id", "name", "release_count", "first_year", "last_year"
    )


def _newest() -> list[Column]:
    return [F.col("year").desc_nulls_last(), F.col("title"), F.col("release_id")]


# Names in a by-line: a line to read, cut per release on the map side.
BY_LINE = 1000


def _first_labels(refs: DataFrame) -> DataFrame:
    """(release_id, label, label_id): the first label of each release."""
    first = F.min_by(F.struct("name", "label_id"), F.struct("position", "label_id", "name"))
    return refs.groupBy("release_id").agg(first.alias("first")).select(
        "release_id", F.col("first.name").alias("label"), F.col("first.label_id").alias("label_id")
    )


def _dated(rows: DataFrame, releases: DataFrame) -> DataFrame:
    return rows.join(releases.select(F.col("id").alias("release_id"), "title", "year"), "release_id")


def artist_release_list(tables: Tables, id: int | None = None) -> DataFrame:
    """(artist_id, release_id, title, year, label, label_id, roles): a covering row per artist and
    release, roles distinct and joined by a comma, null where the artist is on the line alone."""
    line = _only(tables["release_artists"], "artist_id", id).select(
        "artist_id", "release_id", F.lit(None).cast("string").alias("role")
    )
    credits = _only(tables["release_credits"], "artist_id", id).select("artist_id", "release_id", "role")
    held = line.unionByName(credits).groupBy("artist_id", "release_id").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    roles = F.when(F.size("roles") > 0, F.array_join("roles", ","))
    refs = tables["release_labels"]
    if id is not None:
        refs = refs.join(held.select("release_id"), "release_id", "left_semi")
    return _dated(held, tables["releases"]).join(_first_labels(refs), "release_id", "left").select(
        "artist_id", "release_id", "title", "year", "label", "label_id", roles.alias("roles")
    )


def label_release_list(tables: Tables, id: int | None = None, by_line: int = BY_LINE) -> DataFrame:
    """(label_id, release_id, title, year, catno, by_line): a covering row per label and release,
    with its lowest catalogue entry and at most ``by_line`` names of the release's line, in order."""
    once = (
        _only(tables["release_labels"], "label_id", id)
        .groupBy("label_id", "release_id")
        .agg(F.min(F.struct("position", "catno")).alias("entry"))
    )
    line = tables["release_artists"].select("release_id", "position", "name")
    if id is not None:
        line = line.join(once.select("release_id"), "release_id", "left_semi")
    first = R.top_k_per_group(line, ["release_id"], [F.col("position"), F.col("name")], by_line)
    lines = first.groupBy("release_id").agg(F.array_sort(F.collect_list(F.struct("position", "name"))).alias("names"))
    lines = lines.select("release_id", F.array_join("names.name", " ").alias("by_line"))
    return _dated(once, tables["releases"]).join(lines, "release_id", "left").select(
        "label_id", "release_id", "title", "year", F.col("entry.catno").alias("catno"), "by_line"
    )


def artist_releases(tables: Tables, id: int | None = None, limit: int = 300) -> DataFrame:
    """Newest first, with the artist's distinct roles and the release's first label; read from
    ``artist_release_list`` where it is stored, which holds all that a row shows."""
    held = tables.get("artist_release_list")
    rows = _only(held, "artist_id", id) if held is not None else artist_release_list(tables, id)
    return _best(rows, "artist_id", _newest(), limit, id).select(
        "artist_id", "place", "release_id", "title", "year", "label", "label_id", "roles"
    )


def label_releases(tables: Tables, id: int | None = None, limit: int = 300) -> DataFrame:
    """Newest first, once per release, with its lowest catalogue entry and the by-line; read from
    ``label_release_list`` where it is stored."""
    held = tables.get("label_release_list")
    rows = _only(held, "label_id", id) if held is not None else label_release_list(tables, id)
    return _best(rows, "label_id", _newest(), limit, id).select(
        "label_id", "place", "release_id", "title", "year", "catno", "by_line"
    )


def relations(tables: Tables, id: int | None = None) -> DataFrame:
    """Aliases, members and groups read from both sides, the far side inverted."""
    rows = tables["artist_relations"]
    inverse = (
        F.when(F.col("kind") == "member", "group")
        .when(F.col("kind") == "group", "member")
        .otherwise("alias")
    )
    forward = _only(rows, "artist_id", id).select(
        "artist_id", F.col("related_id").alias("other_id"), "kind", "related_name"
    )
    backward = _only(rows, "related_id", id).select(
        F.col("related_id").alias("artist_id"),
        F.col("artist_id").alias("other_id"),
        inverse.alias("kind"),
        F.lit(None).cast("string").alias("related_name"),
    )
    # From the far side only an artist with its own row is shown, which the name test ensures.
    named = R.left_join_all(
        forward.unionByName(backward),
        [
            _names(tables["artists"], "other_id"),
            tables["artist_coverage"].select(F.col("artist_id").alias("other_id"), "release_count"),
            tables["corpus_artists"].select(
                F.col("artist_id").alias("other_id"), F.lit(True).alias("in_corpus")
            ),
        ],
        "other_id",
    )
    return (
        named.select(
            "artist_id",
            "other_id",
            "kind",
            F.coalesce("name", "related_name").alias("name"),
            F.coalesce("release_count", F.lit(0)).alias("release_count"),
            F.coalesce("in_corpus", F.lit(False)).alias("in_corpus"),
        )
        .filter(F.coalesce("name", F.lit("")) != "")
        .distinct()
        .orderBy("artist_id", F.col("release_count").desc(), "other_id", "kind", "name")
    )


# --- search ---------------------------------------------------------------------------


def search(tables: Tables, query: str, limit: int = 40) -> DataFrame:
    """Artists and labels whose name holds the phrase, merged by grade, best first.

    Expects ``artist_search`` and ``label_search`` as (id, norm_name); with ``artist_postings``
    and ``label_postings`` beside them, a range of each is read and no name is scanned.
    ``truncated`` tells that either kind reached the limit.
    """
    phrase = T.normalise_query(F.lit(query))

    def found(kind: str) -> DataFrame:
        index, postings = tables[f"{kind}_search"], tables.get(f"{kind}_postings")
        if postings is not None:
            return E.phrase_ids(postings, index, query)
        return index.filter(T.matches_phrase(F.col("norm_name"), phrase)).select("id")

    artists = (
        R.left_join_all(
            found("artist").join(tables["artists"].select("id", "name"), "id"),
            [
                tables["artist_coverage"].select(
                    F.col("artist_id").alias("id"), "release_count", "relevance"
                ),
                tables["corpus_artists"].withColumnRenamed("artist_id", "id"),
            ],
            "id",
        )
        .select(
            F.lit("artist").alias("kind"),
            "id",
            "name",
            F.coalesce("release_count", F.lit(0)).alias("release_count"),
            F.coalesce("relevance", F.lit("none")).alias("relevance"),
            P.connection(F.col("channel_a"), F.col("channel_b")).alias("connection"),
            F.coalesce("is_seed", F.lit(False)).alias("is_seed"),
        )
        .orderBy(F.col("is_seed").desc(), F.col("release_count").desc(), "id")
        .limit(limit)
        .drop("is_seed")
    )
    named = found("label").join(tables["labels"].select("id", "name"), "id")
    releases = (
        tables["release_labels"]
        .select(F.col("label_id").alias("id"), "release_id")
        .join(named.select("id"), "id", "left_semi")
        .groupBy("id")
        .agg(F.countDistinct("release_id").alias("release_count"))
    )
    grades = tables["label_coverage"].select(F.col("label_id").alias("id"), "relevance")
    labels = (
        R.left_join_all(named, [releases, grades], "id")
        .select(
            F.lit("label").alias("kind"),
            "id",
            "name",
            F.coalesce("release_count", F.lit(0)).alias("release_count"),
            F.coalesce("relevance", F.lit("none")).alias("relevance"),
            F.lit(None).cast("string").alias("connection"),
        )
        .orderBy(F.col("release_count").desc(), "id")
        .limit(limit)
    )
    merged = artists.unionByName(labels)
    # Two limits' worth of rows are left, in one partition already; a window over them spills where
    # a gathered list would not.
    full = F.count("*").over(Window.partitionBy("kind")) == limit
    hits = merged.withColumn("full", full).withColumn("truncated", F.max("full").over(Window.partitionBy(F.lit(0)))).drop("full")
    return hits.orderBy(
        P.grade_rank(F.col("relevance")), F.col("release_count").desc(), "kind", "id"
    )


# --- curated top lists ------------------------------------------------------------------


def alias_expansion(relation_rows: DataFrame, ids: Sequence[int]) -> DataFrame:
    """(id): alias neighbours of the ids in either direction, without the ids themselves."""
    listed = list(ids)
    near = R.both_directions(relation_rows, ("alias",))
    return (
        near.filter(F.col("id").isin(listed) & ~F.col("other_id").isin(listed))
        .select(F.col("other_id").alias("id"))
        .distinct()
    )


def anchors(relation_rows: DataFrame, scene: SceneLists) -> DataFrame:
    """(artist_id, listed, alias_of): every anchor with the band it or its alias belongs to."""
    spark = relation_rows.sparkSession
    listed = R.literal_rows(
        spark,
        [("artist_id", "bigint"), ("listed", "int"), ("alias_of", "int")],
        [(i, 0, None) for i in scene.core_artists]
        + [(i, 1, None) for i in scene.named_artists if i not in scene.core_artists],
    )
    alias = lambda ids, band: alias_expansion(relation_rows, ids).select(
        F.col("id").alias("artist_id"),
        F.lit(None).cast("int").alias("listed"),
        F.lit(band).alias("alias_of"),
    )
    return (
        listed.unionByName(alias(scene.core_artists, 0))
        .unionByName(alias(scene.named_artists, 1))
        .groupBy("artist_id")
        .agg(F.min("listed").alias("listed"), F.min("alias_of").alias("alias_of"))
    )


def scene_releases(tables: Tables, scene: SceneLists, anchor_artists: DataFrame) -> DataFrame:
    """(release_id): on a scene label, or with an anchor on the artist line."""
    by_label = R.in_id_list(tables["release_labels"], scene.scene_labels, "label_id")
    by_line = R.semi_join(tables["release_artists"], anchor_artists, "artist_id")
    return R.union_distinct(by_label.select("release_id"), by_line.select("release_id"))


def standing(scene_count: Column, listed: Column, alias_of: Column, alias_floor: int) -> Column:
    """Core or named when listed; an alias takes its artist's band above the floor only."""
    band = lambda c: F.when(c == 0, "core").when(c == 1, "named")
    return F.coalesce(
        band(listed), F.when(scene_count >= alias_floor, band(alias_of)), F.lit("found")
    )


def band_rank(standing_name: Column) -> Column:
    return F.when(standing_name == "core", 0).when(standing_name == "named", 1).otherwise(2)


def scene_of(tables: Tables, scene: SceneLists) -> tuple[DataFrame, DataFrame]:
    """The anchors and scene releases, as built tables where the caller holds them."""
    who = tables.get("scene_anchors")
    if who is None:
        who = anchors(tables["artist_relations"], scene)
    on_scene = tables.get("scene_releases")
    if on_scene is None:
        on_scene = scene_releases(tables, scene, who)
    return who, on_scene.withColumn("on_scene", F.lit(True))


def scene_standings(tables: Tables, scene: SceneLists) -> DataFrame:
    """(id, name, standing, scene_releases, line_releases) of everyone on a scene release.

    Starts from the scene: only the line rows of people found there are counted in full.
    """
    who, on_scene = scene_of(tables, scene)
    line = tables["release_artists"].select("artist_id", "release_id")
    found = line.join(on_scene.select("release_id"), "release_id", "left_semi").distinct()
    on = found.groupBy("artist_id").agg(F.count("*").alias("scene_releases"))
    whole = line.join(on.select("artist_id"), "artist_id", "left_semi").distinct()
    all_ = whole.groupBy("artist_id").agg(F.count("*").alias("line_releases"))
    counts = on.join(all_, "artist_id").withColumnRenamed("artist_id", "id")
    kept = tables["artists"].select("id", "name").filter(
        P.not_a_listed_stand_in(
            F.col("id"), F.col("name"), scene.excluded_ids, scene.excluded_names
        )
    )
    banded = counts.join(kept, "id").join(who.withColumnRenamed("artist_id", "id"), "id", "left")
    return banded.select(
        "id",
        "name",
        standing(
            F.col("scene_releases"), F.col("listed"), F.col("alias_of"), scene.alias_floor
        ).alias("standing"),
        "scene_releases",
        "line_releases",
    )


def top_artists(tables: Tables, scene: SceneLists = SceneLists(), n: int = TOP_LIST_SIZE) -> DataFrame:
    """Band first, then scene work squared over line work."""
    weight = F.col("scene_releases") * F.col("scene_releases") / F.col("line_releases")
    best = (
        scene_standings(tables, scene)
        .withColumn("weight", weight)
        .orderBy(band_rank(F.col("standing")), F.col("weight").desc(), "name", "id")
        .limit(n)
    )
    years = tables["artist_coverage"].select(
        F.col("artist_id").alias("id"), "first_year", "last_year"
    )
    return best.join(years, "id", "left").orderBy(
        band_rank(F.col("standing")), F.col("weight").desc(), "name", "id"
    )


def top_labels(
    tables: Tables,
    listed_artists: DataFrame,
    scene: SceneLists = SceneLists(),
    n: int = TOP_LIST_SIZE,
) -> DataFrame:
    """Ranked by who chose to release there, discounted by the catalogue's scene share.

    ``listed_artists`` is the top artist list; only its core and named bands count.
    """
    refs = tables["release_labels"].select("release_id", "label_id").distinct()
    banded = listed_artists.filter(F.col("standing") != "found").select(
        F.col("id").alias("artist_id"), "standing"
    )
    # Each (label, artist) once, so plain conditional counts are distinct counts.
    chosen = (
        tables["release_artists"]
        .select("release_id", "artist_id")
        .join(banded, "artist_id")
        .join(refs, "release_id")
        .select("label_id", "artist_id", "standing")
        .distinct()
        .groupBy("label_id")
        .agg(
            F.count_if(F.col("standing") == "core").alias("core_artists"),
            F.count_if(F.col("standing") == "named").alias("named_artists"),
        )
    )
    _, on_scene = scene_of(tables, scene)
    totals = (
        refs.join(on_scene, "release_id", "left")
        .groupBy("label_id")
        .agg(F.count("*").alias("releases"), F.count("on_scene").alias("scene_releases"))
    )
    active = R.span_of(tables["label_roster"], "label_id", "first_year", "last_year")
    core = F.coalesce("core_artists", F.lit(0))
    named = F.coalesce("named_artists", F.lit(0))
    ranked = (
        R.left_join_all(
            totals.join(_names(tables["labels"], "label_id"), "label_id"), [chosen], "label_id"
        )
        .withColumn("is_scene", F.col("label_id").isin(list(scene.scene_labels)))
        .withColumn("weight", (3 * core + named) * (F.col("scene_releases") / F.col("releases")))
        .filter((F.col("weight") > 0) | F.col("is_scene"))
        .select(
            F.col("label_id").alias("id"),
            "name",
            F.when(F.col("is_scene"), "core").otherwise("found").alias("standing"),
            "releases",
            "scene_releases",
            core.alias("core_artists"),
            named.alias("named_artists"),
            "weight",
        )
    )
    order = [band_rank(F.col("standing")), F.col("weight").desc(), F.col("name"), F.col("id")]
    best = ranked.orderBy(*order).limit(n)
    return best.join(active.withColumnRenamed("label_id", "id"), "id", "left").orderBy(*order)


# --- pages and text ----------------------------------------------------------------------


def page_size(show: int | float | str | None) -> int:
    """What a page shows, clamped so a request cannot ask for everything."""
    try:
        asked = float(show) if show not in (None, "") else 0.0
    except ValueError:
        return PAGE_SIZE
    if asked != asked or asked in (float("inf"), float("-inf")):
        return PAGE_SIZE
    return min(max(PAGE_SIZE, int(asked // 1)), PAGE_MAX)


def page(
    ranked: DataFrame,
    show: int | str | None,
    order: Sequence[Column],
    total: int,
    sort: str = "ranking",
    name: str = "name",
    key: str = "id",
) -> tuple[DataFrame, int]:
    """The rows shown and how many are left; sorting by name reorders the same list."""
    limit = page_size(show)
    by = [F.col(name), F.col(key)] if sort == "name" else list(order)
    return ranked.orderBy(*by).limit(limit), max(0, total - limit)


def corpus_stats(tables: Tables) -> DataFrame:
    return R.one_row(*[R.row_count(tables[t], t) for t in ("artists", "labels", "releases")])


_REFERENCE = r"(?i)\[(?:a|l)[0-9]+\]"
_MARKUP = (
    r"(?i)\[(?:a|l)[0-9]+\]|\[(?:a|l)=[^\]]+\]|\[url=[^\]]+\][^\[]*\[/url\]|\[/?[biu]\]"
)


def profile_references(entities: DataFrame, artists: DataFrame, labels: DataFrame) -> DataFrame:
    """(entity_id, kind, ref_id, name): every id reference once, named where known."""
    tokens = F.explode(F.regexp_extract_all("profile", F.lit(_REFERENCE), F.lit(0)))
    refs = (
        entities.select(F.col("id").alias("entity_id"), tokens.alias("token"))
        .select(
            "entity_id",
            F.lower(F.substring("token", 2, 1)).alias("kind"),
            F.regexp_extract("token", "([0-9]+)", 1).try_cast("bigint").alias("ref_id"),
        )
        .distinct()
    )
    names = artists.select(F.lit("a").alias("kind"), F.col("id").alias("ref_id"), "name").unionByName(
        labels.select(F.lit("l").alias("kind"), F.col("id").alias("ref_id"), "name")
    )
    return refs.join(names, ["kind", "ref_id"], "left").select("entity_id", "kind", "ref_id", "name")


def render_profile(entities: DataFrame, artists: DataFrame, labels: DataFrame) -> DataFrame:
    """(entity_id, text, links): markup read out, with the links it makes.

    Names found are gathered per entity, then the text is rendered within its row.
    """
    known = (
        profile_references(entities, artists, labels)
        .filter(F.col("name").isNotNull())
        .groupBy("entity_id")
        .agg(
            F.map_from_entries(
                F.collect_list(F.struct(F.concat("kind", F.col("ref_id").cast("string")), "name"))
            ).alias("names")
        )
    )
    rows = entities.select(F.col("id").alias("entity_id"), "profile").join(known, "entity_id", "left")
    tokens = F.regexp_extract_all("profile", F.lit(_MARKUP), F.lit(0))
    gaps = F.split("profile", _MARKUP, -1)
    names = F.coalesce("names", F.create_map().cast("map<string,string>"))

    def read(token: Column) -> Column:
        part = lambda pattern, group: F.regexp_extract(token, pattern, group)
        kind = F.lower(part(r"(?i)^\[(a|l)[0-9]+\]$", 1))
        digits = part(r"^\[.([0-9]+)\]$", 1)
        path = F.when(kind == "a", "artist").otherwise("label")
        href = part(r"(?i)^\[url=([^\]]+)\]", 1)
        label = part(r"(?i)^\[url=[^\]]+\]([^\[]*)\[/url\]$", 1)
        spoken = F.when(label != "", label).otherwise(href)
        nothing = F.lit(None).cast("string")
        return (
            F.when(
                kind != "",
                F.struct(
                    F.coalesce(
                        names[F.concat(kind, digits)], F.concat(path, F.lit(" "), digits)
                    ).alias("text"),
                    F.concat(F.lit("/"), path, F.lit("/"), digits).alias("href"),
                    F.lit(False).alias("outbound"),
                ),
            )
            .when(
                href != "",
                F.struct(
                    spoken.alias("text"),
                    F.when(T.http_host(href).isNotNull(), href).alias("href"),
                    F.lit(True).alias("outbound"),
                ),
            )
            .otherwise(
                F.struct(
                    part(r"(?i)^\[(?:a|l)=([^\]]+)\]$", 1).alias("text"),
                    nothing.alias("href"),
                    F.lit(False).alias("outbound"),
                )
            )
        )

    read_out = rows.select(
        "entity_id", F.transform(tokens, read).alias("parts"), gaps.alias("gaps")
    )
    spoken = F.concat(
        F.array(F.col("gaps")[0]),
        F.transform("parts", lambda p, i: F.concat(p["text"], F.col("gaps")[i + 1])),
    )
    return read_out.select(
        "entity_id",
        F.regexp_replace(F.array_join(spoken, ""), "\r\n", "\n").alias("text"),
        F.filter("parts", lambda p: p["href"].isNotNull()).alias("links"),
    )


def outbound_links(
    entities: DataFrame,
    known_hosts: Sequence[tuple[str, str]] = KNOWN_HOSTS,
    limit: int = LINK_LIMIT,
) -> DataFrame:
    """(entity_id, pos, name, url): an entity's own links, one per site."""
    links = entities.select(
        F.col("id").alias("entity_id"),
        F.posexplode(T.outbound_links(F.col("urls"), known_hosts, limit)).alias("pos", "link"),
    )
    return links.select("entity_id", "pos", "link.name", "link.url")
