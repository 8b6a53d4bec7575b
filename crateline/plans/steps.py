"""The four steps end to end: seed, expand, entities, derive.

Each step writes what later steps read more than once, and counts it while writing, so lineage
never spans two steps and a log row starts no job. Over a ``Store`` a step reads what is complete
for its dials and sources and builds the rest: the corpus expands again from a stored seed
(``load_seed``), and labels are chosen again from stored pairs (``retune_labels``).
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crateline.config import Dials, SceneLists
from crateline.functions import predicates as P
from crateline.operators import corpus as C
from crateline.operators import derive as D
from crateline.operators import entities as E
from crateline.operators import relational as R
from crateline.operators import serve as V
from crateline.plans.staging import Stage
from crateline.plans.store import Recipe, Store
from crateline.sources.readers import in_dump_order
from crateline.sources.tables import append_run, corpus_tables, run_record

_PEOPLE = ("placeholder_ids", "placeholder_names")
_PAIRS = (*_PEOPLE, "placeholder_label_prefix")
_CATALOGUE = ("catalogue",)
# What each stored table is made from, for a ``Store``.
RECIPES: Mapping[str, Recipe] = {
    "label_artist_pairs": Recipe(sources=_CATALOGUE, dials=_PAIRS),
    "seed_releases": Recipe(sources=_CATALOGUE, dials=("seed",)),
    "appearance_counts": Recipe(sources=_CATALOGUE),
    "seed_tally": Recipe(("seed_releases",), _CATALOGUE, (*_PEOPLE, "packaging_roles")),
    "seed_roles": Recipe(("seed_releases",), _CATALOGUE),
    "artist_totals": Recipe(("appearance_counts", "seed_tally")),
    "seed_artists": Recipe(("seed_tally", "artist_totals"), dials=("min_seed_ratio",)),
    "seed_labels": Recipe(("label_artist_pairs", "seed_artists"), dials=("label_min_artists", "label_min_ratio")),
    "channel_flags": Recipe(
        ("seed_artists", "artist_totals", "seed_labels"), _CATALOGUE, (*_PAIRS, "bridge_min_ratio")
    ),
    "releases": Recipe(("seed_releases", "channel_flags"), _CATALOGUE),
    "corpus_artists": Recipe(
        ("seed_artists", "channel_flags"), _CATALOGUE, (*_PEOPLE, "authorship_roles", "max_people_to_admit", "min_ties")
    ),
    "release_artists": Recipe(("releases",), _CATALOGUE),
    "release_credits": Recipe(("releases",), _CATALOGUE),
    "release_labels": Recipe(("releases",), _CATALOGUE, ("placeholder_label_prefix",)),
    "release_styles": Recipe(("releases",), _CATALOGUE),
    "release_genres": Recipe(("releases",), _CATALOGUE),
    "artist_records": Recipe(("corpus_artists",), ("artists",)),
    "label_records": Recipe(("release_labels",), ("labels",)),
    "artists": Recipe(("artist_records", "corpus_artists", "release_artists", "release_credits")),
    "labels": Recipe(("label_records", "release_labels")),
    "artist_relations": Recipe(("artist_records",)),
    "artist_search": Recipe(("artists",)),
    "label_search": Recipe(("labels",)),
    "artist_postings": Recipe(("artist_search",)),
    "label_postings": Recipe(("label_search",)),
    "artist_release_list": Recipe(("release_artists", "release_credits", "release_labels", "releases")),
    "label_release_list": Recipe(("release_artists", "release_labels", "releases")),
    "release_people": Recipe(("release_artists", "release_credits", "corpus_artists")),
    "people_once": Recipe(("release_people",)),
    "artist_collaborators": Recipe(("people_once",), dials=("max_people_per_release",)),
    "artist_labels": Recipe(("people_once", "release_labels", "releases")),
    "coverage_counts": Recipe(("people_once", "releases", "release_credits")),
    "label_coverage": Recipe(("labels", "label_artist_pairs", "seed_artists"), dials=("grades",)),
    "artist_coverage": Recipe(
        ("corpus_artists", "artist_collaborators", "artist_labels", "coverage_counts", "seed_artists", "artist_totals",
         "release_styles", "release_genres"),
        dials=("grades", "traditions"),
    ),
    "scene_anchors": Recipe(("artist_relations",), dials=("scene",)),
    "scene_releases": Recipe(("scene_anchors", "release_artists", "release_labels"), dials=("scene",)),
    "top_artists": Recipe(("scene_anchors", "scene_releases", "artists", "release_artists"), dials=("scene",)),
    "top_labels": Recipe(("top_artists", "labels", "release_labels"), dials=("scene",)),
}


# The tables that joins and groups by release read, and the column that names it.
RELEASE_KEYS: Mapping[str, str] = {
    "seed_releases": "id",
    "releases": "id",
    **{
        name: "release_id"
        for name in ("channel_flags", "release_artists", "release_credits", "release_labels", "release_styles",
                     "release_genres", "release_people", "people_once")
    },
}


def open_store(spark: SparkSession, folder: str, dials: Dials, **sources: str) -> Store:
    """A store of every step's tables. ``sources`` are digests of the catalogue and the entity
    dumps, as ``files.listing_digest`` gives them."""
    return Store(spark, folder, RECIPES, dials, sources)


@dataclass(frozen=True)
class Seed:
    """What the seed step leaves behind, frozen while the corpus expands."""

    pairs: DataFrame
    releases: DataFrame
    tally: DataFrame
    totals: DataFrame
    artists: DataFrame
    labels: DataFrame


SEED_TABLES = ("label_artist_pairs", "seed_releases", "seed_tally", "artist_totals", "seed_artists", "seed_labels")


def select_seed(cat: C.Catalogue, dials: Dials, stage: Stage) -> Seed:
    def pairs():
        if cat.nested is not None:
            records = stage.watch("label_artist_pairs", cat.nested.select("id", "artists", "labels"), **C.record_label_measures(dials))
            return C.label_artist_pairs(replace(cat, nested=records), dials)
        refs = cat.label_refs.select("release_id", "label_id", "name")
        refs = stage.watch("label_artist_pairs", refs, **C.label_ref_measures(dials))
        return C.label_artist_pairs(replace(cat, label_refs=refs), dials)

    def seeds():
        scanned = stage.watch("seed_releases", cat.releases, scanned=F.count("*"))
        return C.seed_releases(replace(cat, releases=scanned), dials.seed)

    first = stage.tables(
        {
            "label_artist_pairs": pairs,
            "seed_releases": seeds,
            "appearance_counts": lambda: C.appearance_counts(C.appearances(cat)),
        }
    )
    people = lambda: C.seed_appearances(cat, first["seed_releases"])
    packaging = F.count_if(P.is_packaging_role(F.col("role"), dials.packaging_roles))
    second = stage.tables(
        {
            "seed_tally": lambda: C.seed_artist_tally(
                stage.watch("seed_tally", people(), packaging_credits=packaging), dials
            ),
            "seed_roles": lambda: C.roles_seen(people().filter(F.col("role").isNotNull())),
        }
    )
    tally = second["seed_tally"]
    # One count over the catalogue serves the seed ratio, the bridge ratio and the displayed
    # share; everyone in the tally is kept, so nothing is counted twice.
    totals = stage.table(
        "artist_totals", lambda: R.semi_join(first["appearance_counts"], tally, "artist_id")
    )
    artists = stage.table(
        "seed_artists", lambda: C.seed_artists(tally, totals, dials.min_seed_ratio)
    )
    pairs_held = first["label_artist_pairs"]
    return Seed(pairs_held, first["seed_releases"], tally, totals, artists, _labels(pairs_held, artists, dials, stage))


def _labels(pairs: DataFrame, artists: DataFrame, dials: Dials, stage: Stage) -> DataFrame:
    candidates = lambda rosters: stage.watch("seed_labels", rosters, candidate_labels=F.count_if(F.col("seeds") > 0))
    return stage.table(
        "seed_labels",
        lambda: C.seed_labels(pairs, artists, dials.label_min_artists, dials.label_min_ratio, candidates),
    )


def load_seed(store: Store) -> Seed:
    """The stored seed, read with no job and without the catalogue; ``Incomplete`` if it is not there."""
    return Seed(*store.need(*SEED_TABLES).values())


def retune_labels(store: Store) -> Seed:
    """The stored seed with its labels chosen by the store's dials, from the stored pairs."""
    held = store.need(*(name for name in SEED_TABLES if name != "seed_labels"))
    labels = _labels(held["label_artist_pairs"], held["seed_artists"], store.dials, store)
    return Seed(*held.values(), labels)


def expand(cat: C.Catalogue, seed: Seed, dials: Dials, stage: Stage) -> dict[str, DataFrame]:
    """The corpus: kept releases and admitted artists, exactly one hop from the seed."""
    people = C.appearances(cat)
    a, b = F.col("channel_a"), F.col("channel_b")

    def channels():
        bridging = C.bridges(seed.artists, seed.totals, dials.bridge_min_ratio)
        bridging = stage.watch("channel_flags", bridging, bridging_artists=F.count("*"))
        found = stage.deal(C.channel_flags(people, cat.label_refs, bridging, seed.labels, dials), "release_id")
        kept = {"kept_a": a & ~b, "kept_b": b & ~a, "kept_both": a & b}
        return stage.watch("channel_flags", found, **{name: F.count_if(test) for name, test in kept.items()})

    flags = stage.table("channel_flags", channels)
    admissible = C.admissible_people(people, dials)

    def admitted():
        crowded = lambda df: stage.watch("corpus_artists", df, crowded_releases=F.count_if("crowded"))
        ties = C.ties_and_label_mates(admissible, flags, C.crowded(admissible, dials.max_people_to_admit), crowded)
        members = C.corpus_artists(seed.artists, ties, dials.min_ties)
        return stage.watch("corpus_artists", members, new_artists=F.count_if(~F.col("is_seed")))

    made = stage.tables(
        {
            "releases": lambda: C.kept_releases(cat.releases, seed.releases, flags),
            "corpus_artists": admitted,
        }
    )
    rest = corpus_tables(cat.within(made["releases"]), dials)
    del rest["releases"]
    written = stage.tables({name: lambda df=df: df for name, df in rest.items()})
    return {**made, **written, "channel_flags": flags}


def select_corpus(cat: C.Catalogue, dials: Dials, stage: Stage) -> dict[str, DataFrame]:
    seed = select_seed(cat, dials, stage)
    return corpus_of(seed, expand(cat, seed, dials, stage))


def corpus_of(seed: Seed, expanded: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    return {
        **expanded,
        "label_artist_pairs": seed.pairs,
        "seed_artists": seed.artists,
        "seed_artist_totals": seed.totals,
        "seed_labels": seed.labels,
        "roles_seen": C.roles_seen(expanded["release_credits"]),
    }


def load_entities(
    corpus: Mapping[str, DataFrame],
    artists_nested: DataFrame,
    labels_nested: DataFrame,
    stage: Stage,
) -> dict[str, DataFrame]:
    """Names, relations and search columns. Each dump is parsed once, whatever reads it after; of
    records that repeat an id the last one counts."""
    members = corpus["corpus_artists"]
    wanted = members.select(F.col("artist_id").alias("id"))
    on_releases = corpus["release_labels"].select(F.col("label_id").alias("id"))

    def records(name: str, dump: DataFrame, ids: DataFrame, scanned: str) -> DataFrame:
        watched = stage.watch(name, in_dump_order(dump), **{scanned: F.count("*")})
        return R.replace_by_key(watched.join(ids, "id", "left_semi"), ["id"], "_seq").drop("_seq")

    kept = stage.tables(
        {
            "artist_records": lambda: records("artist_records", artists_nested, wanted, "artists_scanned"),
            "label_records": lambda: records("label_records", labels_nested, on_releases.distinct(), "labels_scanned"),
        }
    )
    named = stage.tables(
        {
            "artists": lambda: E.fallback_names(
                kept["artist_records"].select(*E.ARTIST_COLUMNS),
                wanted,
                E.artist_name_refs(corpus["release_artists"], corpus["release_credits"]),
            ),
            "labels": lambda: E.fallback_names(
                kept["label_records"].select(*E.LABEL_COLUMNS), on_releases, E.label_name_refs(corpus["release_labels"])
            ),
            "artist_relations": lambda: E.listed_relations(kept["artist_records"]),
        }
    )
    indexes = stage.tables(
        {
            "artist_search": lambda: E.search_index(named["artists"]),
            "label_search": lambda: E.search_index(named["labels"]),
        }
    )
    return {**named, **indexes}


def derive(
    corpus: Mapping[str, DataFrame], labels: DataFrame, dials: Dials, stage: Stage
) -> dict[str, DataFrame]:
    D.pairs_guard(corpus["release_labels"], corpus["label_artist_pairs"])
    people = stage.table(
        "release_people",
        lambda: stage.deal(
            D.release_people(corpus["release_artists"], corpus["release_credits"], corpus["corpus_artists"]),
            "release_id",
        ),
    )
    once = stage.table("people_once", lambda: D.people_once(people))
    paired = lambda groups: stage.watch("artist_collaborators", groups, pairable=F.count("*"))
    made = stage.tables(
        {
            "artist_collaborators": lambda: D.artist_collaborators(
                people, dials.max_people_per_release, once, paired
            ),
            "artist_labels": lambda: D.artist_labels(
                once, corpus["release_labels"], corpus["releases"]
            ),
            "coverage_counts": lambda: D.coverage_counts(
                once, corpus["releases"], corpus["release_credits"]
            ),
            "label_coverage": lambda: D.label_coverage(
                labels, corpus["label_artist_pairs"], corpus["seed_artists"], dials.grades
            ),
        }
    )
    measured = lambda: measured_coverage(
        corpus,
        once,
        made["artist_collaborators"],
        made["artist_labels"],
        made["coverage_counts"],
        dials,
    )
    coverage = stage.table(
        "artist_coverage", lambda: D.lineage_floor(measured(), dials.traditions)
    )
    return {
        **made,
        "release_people": people,
        "people_once": once,
        "label_roster": D.label_roster(made["artist_labels"]),
        "artist_coverage": coverage,
    }


def lineage(
    corpus: Mapping[str, DataFrame], once: DataFrame, counts: DataFrame, dials: Dials
) -> DataFrame:
    """(artist_id, rule, n) over both kinds of rule."""
    rules = dials.traditions
    matches = D.tag_matches(corpus["release_styles"], corpus["release_genres"], rules).unionByName(
        D.label_matches(corpus["release_labels"], rules)
    )
    return D.lineage_candidates(once, matches, counts, rules)


def measured_coverage(
    corpus: Mapping[str, DataFrame],
    once: DataFrame,
    pairs: DataFrame,
    by_artist: DataFrame,
    counts: DataFrame,
    dials: Dials,
) -> DataFrame:
    tags = D.lineage_tags(lineage(corpus, once, counts, dials), dials.traditions)
    return D.artist_coverage(
        corpus["corpus_artists"],
        counts,
        pairs,
        by_artist,
        tags,
        corpus["seed_artists"],
        corpus["seed_artist_totals"],
        dials.grades,
    )


def top_lists(tables: Mapping[str, DataFrame], scene: SceneLists, stage: Stage) -> dict[str, DataFrame]:
    """The two curated lists, their scene worked out once and kept."""
    who = stage.table("scene_anchors", lambda: V.anchors(tables["artist_relations"], scene))
    on_scene = stage.table("scene_releases", lambda: V.scene_releases(tables, scene, who))
    held = {**tables, "scene_anchors": who, "scene_releases": on_scene}
    artists = stage.table("top_artists", lambda: V.top_artists(held, scene))
    labels = stage.table("top_labels", lambda: V.top_labels(held, artists, scene))
    return {"top_artists": artists, "top_labels": labels}


def serving_tables(tables: Mapping[str, DataFrame], stage: Stage) -> dict[str, DataFrame]:
    """What lookups read instead of joining: search postings by text, releases by artist and by label."""
    return stage.tables(
        {
            "artist_postings": lambda: R.clustered(E.search_postings(tables["artist_search"]), "text"),
            "label_postings": lambda: R.clustered(E.search_postings(tables["label_search"]), "text"),
            "artist_release_list": lambda: R.clustered(V.artist_release_list(tables), "artist_id"),
            "label_release_list": lambda: R.clustered(V.label_release_list(tables), "label_id"),
        }
    )


def seed_stats(stage: Stage) -> dict[str, int]:
    """What the seed step counted while writing."""
    n = stage.counts
    candidates, kept = n["seed_tally"]["rows"], n["seed_artists"]["rows"]
    return {
        "scanned": n["seed_releases"]["scanned"],
        "seed_releases": n["seed_releases"]["rows"],
        "seed_artists": kept,
        "candidate_labels": n["seed_labels"]["candidate_labels"],
        "seed_labels": n["seed_labels"]["rows"],
        "distinct_roles": n["seed_roles"]["rows"],
        "packaging_credits": n["seed_tally"]["packaging_credits"],
        "labels_without_id": n["label_artist_pairs"]["labels_without_id"],
        "placeholder_labels": n["label_artist_pairs"]["placeholder_labels"],
        "seed_candidates": candidates,
        "dropped_by_ratio": candidates - kept,
    }


def expansion_stats(stage: Stage) -> dict[str, int | float | None]:
    """What the expansion counted while writing, over what the seed step had counted."""
    n, flags = stage.counts, stage.counts["channel_flags"]
    kept, total = {k: flags[k] for k in ("kept_a", "kept_b", "kept_both")}, flags["rows"]
    return {
        "scanned": n["seed_releases"]["scanned"],
        **kept,
        "total_kept": total,
        "crowded_releases": n["corpus_artists"]["crowded_releases"],
        "corpus_artists": n["corpus_artists"]["rows"],
        "new_artists": n["corpus_artists"]["new_artists"],
        "seed_artists": n["seed_artists"]["rows"],
        "suppressed_bridges": n["seed_artists"]["rows"] - flags["bridging_artists"],
        **{k.replace("kept", "pct"): 100 * v / total if total else None for k, v in kept.items()},
    }


def entity_stats(stage: Stage) -> dict[str, int]:
    n = stage.counts
    stats = {}
    for kind in ("artist", "label"):
        kept = n[f"{kind}_records"]["rows"]
        stats |= {
            f"{kind}s_scanned": n[f"{kind}_records"][f"{kind}s_scanned"],
            f"{kind}s_kept": kept,
            f"{kind}s_missing": n[f"{kind}s"]["rows"] - kept,
        }
    return {**stats, "relations": n["artist_relations"]["rows"]}


def derivation_stats(stage: Stage) -> dict[str, int]:
    n = stage.counts
    rows = lambda name: n[name]["rows"]
    return {
        "artist_collaborators": rows("artist_collaborators"),
        "artist_labels": rows("artist_labels"),
        "label_roster": rows("artist_labels"),
        "artist_coverage": rows("artist_coverage"),
        "label_coverage": rows("label_coverage"),
        "releases_skipped": rows("releases") - n["artist_collaborators"]["pairable"],
    }


def build(
    cat: C.Catalogue,
    artists_nested: DataFrame,
    labels_nested: DataFrame,
    dials: Dials,
    stage: Stage,
    run_log: str | None = None,
    source_file: str | None = None,
) -> dict[str, DataFrame]:
    """Every table, from a catalogue and its two entity dumps; over a ``Store``, what is complete
    there is read.

    With ``run_log`` given, each step adds a row with its dials and counts to that folder.
    """
    config = asdict(dials)

    def step(name, make, stats):
        started = datetime.now(timezone.utc).isoformat()
        made = make()
        if run_log is not None:
            append_run(stage.spark, run_record(stats(stage), name, source_file, config, started), run_log)
        return made

    seed = step("pass1", lambda: select_seed(cat, dials, stage), seed_stats)
    corpus = step("pass2", lambda: corpus_of(seed, expand(cat, seed, dials, stage)), expansion_stats)
    entities = step("entities", lambda: load_entities(corpus, artists_nested, labels_nested, stage), entity_stats)
    derived = step("derive", lambda: derive(corpus, entities["labels"], dials, stage), derivation_stats)
    tables = {**corpus, **entities, **derived}
    return {**tables, **serving_tables(tables, stage), **top_lists(tables, dials.scene, stage)}
