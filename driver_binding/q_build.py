"""Corpus selection, entities and derived tables."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from crateline.operators import corpus as C
from crateline.operators import derive as D
from crateline.operators import entities as E
from crateline.plans import steps
from crateline.plans.staging import Stage
from crateline.sources.readers import read_releases, release_xml_rows, to_bronze, write_xml
from driver_binding.catalogue import DIALS, NESTED_DIALS, nested_releases
from driver_binding.oracle import GRADE_RANK, K, anew, marker, seed_rule
from driver_binding.q_sources import digest_sql, digests
from driver_binding.registry import query


def counted(b, stats):
    """One row of what steps counted while they wrote their tables."""
    cell = lambda v: F.lit(v).cast("bigint" if isinstance(v, int) else "double")
    return b.spark.range(1).select(*(cell(v).alias(name) for name, v in stats.items()))


# --- corpus -------------------------------------------------------------------------------


@query("c1_label_artist_pairs", "SELECT label_id, artist_id FROM k_pairs")
def label_artist_pairs(b):
    return C.label_artist_pairs(b.cat, b.dials)


@query("c2_seed_releases", "SELECT id, title, year FROM k_seed_rel")
def seed_releases(b):
    return C.seed_releases(b.cat, b.dials.seed)


@query("c3_seed_artist_tally", "SELECT artist_id, seed_releases FROM k_tally")
def seed_artist_tally(b):
    return C.seed_artist_tally(C.seed_appearances(b.cat, b.seed.releases), b.dials)


@query("c4_artist_totals", "SELECT artist_id, total FROM k_totals")
def artist_totals(b):
    return C.artist_totals(C.appearances(b.cat), b.seed.tally)


@query("c5_seed_artists", "SELECT artist_id, seed_releases, total_releases FROM k_seed_art")
def seed_artists(b):
    return C.seed_artists(b.seed.tally, b.seed.totals, b.dials.min_seed_ratio)


@query("c6_seed_labels", "SELECT label_id, seed_artist_count, total_artist_count, seed_ratio FROM k_seed_lab")
def seed_labels(b):
    return C.seed_labels(b.seed.pairs, b.seed.artists, b.dials.label_min_artists, b.dials.label_min_ratio)


CANDIDATES = "SELECT count(DISTINCT label_id) FROM k_pairs WHERE artist_id IN (SELECT artist_id FROM k_seed_art)"


@query("c7_candidate_labels", f"SELECT ({CANDIDATES}) AS candidate_labels")
def candidate_labels(b):
    return C.candidate_labels(b.seed.pairs, b.seed.artists)


@query("c8_roles_seen", "SELECT role, count(*) AS occurrences FROM k_c_cred GROUP BY 1")
def roles_seen(b):
    return C.roles_seen(b.corpus["release_credits"])


@query("c9_bridges", "SELECT artist_id FROM k_bridges")
def bridges(b):
    return _bridges(b)


def _bridges(b):
    return C.bridges(b.seed.artists, b.seed.totals, b.dials.bridge_min_ratio)


@query(
    "c10_channel_flags",
    """SELECT release_id, CAST(channel_a AS BIGINT) AS channel_a, CAST(channel_b AS BIGINT) AS channel_b
        FROM k_flags""",
)
def channel_flags(b):
    return C.channel_flags(C.appearances(b.cat), b.cat.label_refs, _bridges(b), b.seed.labels, b.dials)


@query(
    "c11_kept_releases",
    """SELECT id, title, year, CAST(is_seed AS BIGINT) AS is_seed, CAST(channel_a AS BIGINT) AS channel_a,
        CAST(channel_b AS BIGINT) AS channel_b FROM k_kept""",
)
def kept_releases(b):
    return C.kept_releases(b.cat.releases, b.seed.releases, b.corpus["channel_flags"])


def _admissible(b):
    return C.admissible_people(C.appearances(b.cat), b.dials)


@query("c12_admissible_people", "SELECT release_id, artist_id, name, role FROM k_admiss")
def admissible_people(b):
    return _admissible(b)


@query("c13_crowded", "SELECT release_id, CAST(crowded AS BIGINT) AS crowded FROM k_crowd")
def crowded(b):
    return C.crowded(_admissible(b), b.dials.max_people_to_admit)


@query("c14_ties_and_label_mates", "SELECT artist_id, ties_a, CAST(via_b AS BIGINT) AS via_b FROM k_ties")
def ties_and_label_mates(b):
    people = _admissible(b)
    crowds = C.crowded(people, b.dials.max_people_to_admit)
    return C.ties_and_label_mates(people, b.corpus["channel_flags"], crowds)


CORPUS_ARTISTS = """SELECT artist_id, CAST(is_seed AS BIGINT) AS is_seed, CAST(channel_a AS BIGINT) AS channel_a,
        CAST(channel_b AS BIGINT) AS channel_b FROM k_corpus"""


@query("c15_corpus_artists", CORPUS_ARTISTS)
def corpus_artists(b):
    people = _admissible(b)
    crowds = C.crowded(people, b.dials.max_people_to_admit)
    ties = C.ties_and_label_mates(people, b.corpus["channel_flags"], crowds)
    return C.corpus_artists(b.seed.artists, ties, b.dials.min_ties)


@query(
    "c16_pass1_stats",
    f"""SELECT (SELECT count(*) FROM k_rel) AS scanned, (SELECT count(*) FROM k_seed_rel) AS seed_releases,
        (SELECT count(*) FROM k_seed_art) AS seed_artists, ({CANDIDATES}) AS candidate_labels,
        (SELECT count(*) FROM k_seed_lab) AS seed_labels,
        (SELECT count(DISTINCT role) FROM k_seed_app) AS distinct_roles,
        (SELECT count(*) FROM k_seed_app WHERE {marker('role', DIALS.packaging_roles)}) AS packaging_credits,
        (SELECT count(*) FROM k_lab WHERE label_id IS NULL) AS labels_without_id,
        (SELECT count(*) FROM k_lab WHERE label_id IS NOT NULL) - (SELECT count(*) FROM k_usable) AS placeholder_labels,
        (SELECT count(*) FROM k_tally) AS seed_candidates,
        (SELECT count(*) FROM k_tally) - (SELECT count(*) FROM k_seed_art) AS dropped_by_ratio""",
)
def pass1_stats(b):
    b.seed  # noqa: B018 - counted when written
    return counted(b, steps.seed_stats(b.stage))


@query(
    "c17_pass2_stats",
    """SELECT *, 100 * kept_a / total_kept AS pct_a, 100 * kept_b / total_kept AS pct_b,
        100 * kept_both / total_kept AS pct_both FROM (
        SELECT (SELECT count(*) FROM k_rel) AS scanned,
        count(*) FILTER (WHERE channel_a AND NOT channel_b) AS kept_a,
        count(*) FILTER (WHERE channel_b AND NOT channel_a) AS kept_b,
        count(*) FILTER (WHERE channel_a AND channel_b) AS kept_both, count(*) AS total_kept,
        count(*) FILTER (WHERE crowded) AS crowded_releases,
        (SELECT count(*) FROM k_corpus) AS corpus_artists,
        (SELECT count(*) FROM k_corpus WHERE NOT is_seed) AS new_artists,
        (SELECT count(*) FROM k_seed_art) AS seed_artists,
        (SELECT count(*) FROM k_seed_art) - (SELECT count(*) FROM k_bridges) AS suppressed_bridges
        FROM k_flags LEFT JOIN k_crowd USING (release_id))""",
)
def pass2_stats(b):
    b.corpus  # noqa: B018
    return counted(b, steps.expansion_stats(b.stage))


@query("c18_select_corpus", CORPUS_ARTISTS)
def select_corpus(b):
    """The whole selection again in a stage of its own."""
    return steps.select_corpus(b.cat, b.dials, b.new_stage())["corpus_artists"]


# Every table of a selection: its subquery, and the columns that its digest takes in.
SELECTED = {
    "releases": ("k_kept", ("id", "title", "year", "is_seed", "channel_a", "channel_b")),
    "release_artists": ("k_c_line", ("release_id", "position", "artist_id", "name", "join_phrase")),
    "release_credits": ("k_c_cred", ("release_id", "position", "artist_id", "name", "role")),
    "release_labels": ("k_c_lab", ("release_id", "position", "label_id", "name", "catno")),
    "release_styles": ("k_c_sty", ("release_id", "style")),
    "release_genres": ("k_c_gen", ("release_id", "genre")),
    "corpus_artists": ("k_corpus", ("artist_id", "is_seed", "channel_a", "channel_b")),
    "channel_flags": ("k_flags", ("release_id", "channel_a", "channel_b")),
    "label_artist_pairs": ("k_pairs", ("label_id", "artist_id")),
    "seed_artists": ("k_seed_art", ("artist_id", "seed_releases", "total_releases")),
    "seed_artist_totals": ("k_totals", ("artist_id", "total")),
    "seed_labels": ("k_seed_lab", ("label_id", "seed_artist_count", "total_artist_count")),
    "roles_seen": ("(SELECT role, count(*) AS occurrences FROM k_c_cred GROUP BY 1)", ("role", "occurrences")),
}
# The nested records as a catalogue, for the subqueries of a selection.
NESTED = {
    "k_rel": "SELECT id, title, year FROM k_nested",
    "k_line": "SELECT * FROM k_n_line",
    "k_cred": "SELECT * FROM k_n_cred",
    "k_lab": "SELECT * FROM k_n_lab",
    "k_sty": "SELECT id AS release_id, unnest([segment, concat('Nation style ', nation)]) AS style FROM k_nested",
    "k_gen": "SELECT id AS release_id, genre FROM k_nested",
    **seed_rule(NESTED_DIALS.seed),
    "k_label_counts": K["k_label_counts"],
    "k_seed_lab": K["k_seed_lab"].replace(str(DIALS.label_min_ratio), str(NESTED_DIALS.label_min_ratio)),
}


@query(
    "c18_select_nested",
    " UNION ALL ".join(
        digest_sql(name, source.replace("k_", "k_nest_"), columns) for name, (source, columns) in SELECTED.items()
    ),
    anew("nest", NESTED),
)
def select_nested(b):
    """The selection over nested records as a dump gives them, from XML over bronze to tables;
    rows and digest of every table."""
    folder = f"{b.stage.folder}/dump-{uuid4().hex}"
    write_xml(release_xml_rows(nested_releases(b.spark, b.sf_dir)), f"{folder}/xml", "releases", "release")
    nested = to_bronze(read_releases(b.spark, f"{folder}/xml"), f"{folder}/bronze")
    made = steps.select_corpus(C.from_records(nested, NESTED_DIALS.seed), NESTED_DIALS, Stage(b.spark))
    return digests({name: made[name] for name in SELECTED}, {name: columns for name, (_, columns) in SELECTED.items()})


# --- entities -------------------------------------------------------------------------------


@query(
    "e1_corpus_artist_entities",
    """SELECT id, name, real_name, profile, array_to_string(urls, chr(10)) AS urls FROM k_adump
        WHERE id IN (SELECT artist_id FROM k_corpus)""",
)
def corpus_artist_entities(b):
    return E.corpus_artist_entities(b.artists_dump, b.corpus["corpus_artists"])


@query(
    "e2_corpus_label_entities",
    """SELECT id, name, profile, array_to_string(urls, chr(10)) AS urls FROM k_ldump
        WHERE id IN (SELECT label_id FROM k_c_lab)""",
)
def corpus_label_entities(b):
    return E.corpus_label_entities(b.labels_dump, b.corpus["release_labels"])


def _written_twice(dump):
    """Each record twice, first under another name and without the rest: the last one counts."""
    before = dump.withColumn("name", F.lit("Before"))
    for column, kind in dump.dtypes:
        if column not in ("id", "name"):
            before = before.withColumn(column, F.lit(None).cast(kind))
    return before.unionByName(dump)


@query(
    "e1_repeated_records",
    """SELECT 'artist' AS kind, id, name, real_name, profile, array_to_string(urls, chr(10)) AS urls FROM k_artists
        UNION ALL SELECT 'label', id, name, NULL, profile, array_to_string(urls, chr(10)) FROM k_labels
        UNION ALL SELECT kind, artist_id, related_name, CAST(related_id AS VARCHAR), NULL, NULL FROM k_relations""",
)
def repeated_records(b):
    """The entities step over dumps that hold every artist and label twice."""
    dumps = (_written_twice(d) for d in (b.artists_dump, b.labels_dump))
    made = steps.load_entities(b.corpus, *dumps, Stage(b.spark))
    artists = made["artists"].select(F.lit("artist").alias("kind"), "id", "name", "real_name", "profile", "urls")
    labels = made["labels"].select(F.lit("label").alias("kind"), "id", "name", "profile", "urls")
    relations = made["artist_relations"].select(
        "kind", F.col("artist_id").alias("id"), F.col("related_name").alias("name"),
        F.col("related_id").cast("string").alias("real_name"),
    )
    return artists.unionByName(labels, allowMissingColumns=True).unionByName(relations, allowMissingColumns=True)


@query("e3_artist_relations", "SELECT artist_id, related_id, kind, related_name FROM k_relations")
def artist_relations(b):
    return E.artist_relations(b.artists_dump, b.corpus["corpus_artists"])


@query("e4_fallback_names", "SELECT id, name, real_name, profile FROM k_artists")
def fallback_names(b):
    members = b.corpus["corpus_artists"]
    named = E.fallback_names(
        E.corpus_artist_entities(b.artists_dump, members),
        members.select(F.col("artist_id").alias("id")),
        E.artist_name_refs(b.corpus["release_artists"], b.corpus["release_credits"]),
    )
    return named.drop("urls")


@query(
    "e5_entity_stats",
    """SELECT (SELECT count(*) FROM k_adump) AS artists_scanned, a.kept AS artists_kept,
        (SELECT count(*) FROM k_corpus) - a.kept AS artists_missing,
        (SELECT count(*) FROM k_ldump) AS labels_scanned, l.kept AS labels_kept,
        (SELECT count(DISTINCT label_id) FROM k_c_lab) - l.kept AS labels_missing,
        (SELECT count(*) FROM k_relations) AS relations
        FROM (SELECT count(*) AS kept FROM k_adump WHERE id IN (SELECT artist_id FROM k_corpus)) a,
             (SELECT count(*) AS kept FROM k_ldump WHERE id IN (SELECT label_id FROM k_c_lab)) l""",
)
def entity_stats(b):
    b.entities  # noqa: B018
    return counted(b, steps.entity_stats(b.stage))


@query(
    "e6_search_index",
    r"""SELECT doc_id AS id, md5(trim(regexp_replace(strip_accents(lower(text)), '[^\p{L}\p{N}]+', ' ', 'g'))) AS digest
        FROM documents""",
)
def search_index(b):
    """Whole document texts in four languages, folded; compared by digest."""
    docs = b.spark.read.parquet(f"{b.sf_dir}/documents.parquet")
    index = E.search_index(docs, "doc_id", "text")
    return index.select("id", F.md5(F.trim("norm_name").cast("binary")).alias("digest"))


# --- derived ----------------------------------------------------------------------------------


@query("d1_release_people", "SELECT release_id, artist_id, role FROM k_people")
def release_people(b):
    c = b.corpus
    return D.release_people(c["release_artists"], c["release_credits"], c["corpus_artists"])


@query("d2_pairable", "SELECT release_id FROM k_pairable")
def pairable(b):
    return D.pairable(b.derived["people_once"], b.dials.max_people_per_release)


@query(
    "d3_releases_skipped",
    "SELECT (SELECT count(*) FROM k_kept) - (SELECT count(*) FROM k_pairable) AS releases_skipped",
)
def releases_skipped(b):
    return _skipped(b)


def _skipped(b):
    pairs_from = D.pairable(b.derived["people_once"], b.dials.max_people_per_release)
    return D.releases_skipped(b.corpus["releases"], pairs_from)


@query("d4_pair_counts", "SELECT aid, bid, n FROM k_pair_counts")
def pair_counts(b):
    return D.pair_counts(b.derived["release_people"], b.dials.max_people_per_release)


@query("d5_pair_roles", "SELECT aid, bid, roles FROM k_pair_roles")
def pair_roles(b):
    d = b.derived
    return D.pair_roles(d["release_people"], b.dials.max_people_per_release, d["people_once"])


@query("d6_artist_collaborators", "SELECT artist_id, collaborator_id, shared_releases, roles FROM k_collab")
def artist_collaborators(b):
    d = b.derived
    return D.artist_collaborators(d["release_people"], b.dials.max_people_per_release, d["people_once"])


@query("d7_artist_labels", "SELECT artist_id, label_id, release_count, first_year, last_year FROM k_alabels")
def artist_labels(b):
    return D.artist_labels(b.derived["people_once"], b.corpus["release_labels"], b.corpus["releases"])


@query("d8_label_roster", "SELECT label_id, artist_id, release_count, first_year, last_year FROM k_alabels")
def label_roster(b):
    return D.label_roster(b.derived["artist_labels"])


@query("d9_coverage_counts", "SELECT artist_id, release_count, credited_releases, seed_n, first_year, last_year FROM k_cov")
def coverage_counts(b):
    return D.coverage_counts(b.derived["people_once"], b.corpus["releases"], b.corpus["release_credits"])


@query(
    "d10_collab_and_label_counts",
    """SELECT artist_id, collab_n, label_n FROM (SELECT artist_id, count(*) AS collab_n FROM k_collab GROUP BY 1)
        FULL JOIN (SELECT artist_id, count(*) AS label_n FROM k_alabels GROUP BY 1) USING (artist_id)""",
)
def collab_and_label_counts(b):
    collab = D.rows_per_artist(b.derived["artist_collaborators"], "collab_n")
    return collab.join(D.rows_per_artist(b.derived["artist_labels"], "label_n"), "artist_id", "full")


@query(
    "d11_seed_counts",
    """SELECT artist_id, count(DISTINCT release_id) AS n FROM k_people
        WHERE release_id IN (SELECT id FROM k_kept WHERE is_seed) GROUP BY 1""",
)
def seed_counts(b):
    return D.seed_counts(b.derived["people_once"], b.corpus["releases"])


def _candidates(b, matches):
    rules = b.dials.traditions
    d = b.derived
    return D.rule_names(D.lineage_candidates(d["people_once"], matches, d["coverage_counts"], rules), rules)


TAG_RULES = sum(1 for rule in DIALS.traditions if not rule.labels)


@query("d12_lineage_by_tag", f"SELECT artist_id, rule_name AS rule FROM k_lin_cand WHERE rule < {TAG_RULES}")
def lineage_by_tag(b):
    c = b.corpus
    return _candidates(b, D.tag_matches(c["release_styles"], c["release_genres"], b.dials.traditions))


@query("d13_lineage_by_label", f"SELECT artist_id, rule_name AS rule FROM k_lin_cand WHERE rule >= {TAG_RULES}")
def lineage_by_label(b):
    return _candidates(b, D.label_matches(b.corpus["release_labels"], b.dials.traditions))


@query("d14_lineage_tag", "SELECT artist_id, lineage FROM k_lin_tag")
def lineage_tag(b):
    d = b.derived
    found = steps.lineage(b.corpus, d["people_once"], d["coverage_counts"], b.dials)
    return D.lineage_tags(found, b.dials.traditions)


COVERAGE_COLUMNS = """artist_id, release_count, credited_releases, collaborator_count, label_count, first_year,
        last_year, seed_releases, seed_share, scene_relevance, lineage"""


def _measured(b):
    d = b.derived
    return steps.measured_coverage(
        b.corpus, d["people_once"], d["artist_collaborators"], d["artist_labels"], d["coverage_counts"], b.dials
    )


@query("d15_artist_coverage", f"SELECT {COVERAGE_COLUMNS} FROM k_measured")
def artist_coverage(b):
    return _measured(b).drop("relevance")


@query("d16_lineage_floor", f"SELECT {COVERAGE_COLUMNS}, relevance FROM k_coverage")
def lineage_floor(b):
    return D.lineage_floor(_measured(b), b.dials.traditions)


@query("d17_label_coverage", "SELECT label_id, line_artist_count, seed_artist_count, seed_ratio, relevance FROM k_lcov")
def label_coverage(b):
    return D.label_coverage(b.entities["labels"], b.seed.pairs, b.seed.artists, b.dials.grades)


@query(
    "d18_pairs_guard",
    """SELECT label_id, count(*) AS pairs FROM k_pairs
        WHERE (SELECT count(*) FROM k_c_lab) = 0 OR (SELECT count(*) FROM k_pairs) > 0 GROUP BY 1""",
)
def pairs_guard(b):
    """Passes the guard, then counts the pairs it lets be graded."""
    D.pairs_guard(b.corpus["release_labels"], b.seed.pairs)
    return b.seed.pairs.groupBy("label_id").agg(F.count("*").alias("pairs"))


@query(
    "d19_lineage_summary",
    """SELECT lineage, count(*) AS tagged, count(*) FILTER (WHERE relevance <> scene_relevance) AS lifted
        FROM k_coverage WHERE lineage IS NOT NULL GROUP BY 1""",
)
def lineage_summary(b):
    return D.lineage_summary(b.derived["artist_coverage"])


@query("d20_label_grade_histogram", f"SELECT relevance, count(*) AS labels FROM k_lcov GROUP BY 1 ORDER BY {GRADE_RANK.format('relevance')}")
def label_grade_histogram(b):
    return D.label_grade_histogram(b.derived["label_coverage"])


@query(
    "d21_derive_stats",
    """SELECT (SELECT count(*) FROM k_collab) AS artist_collaborators, (SELECT count(*) FROM k_alabels) AS artist_labels,
        (SELECT count(*) FROM k_alabels) AS label_roster, (SELECT count(*) FROM k_coverage) AS artist_coverage,
        (SELECT count(*) FROM k_lcov) AS label_coverage,
        (SELECT count(*) FROM k_kept) - (SELECT count(*) FROM k_pairable) AS releases_skipped""",
)
def derive_stats(b):
    b.derived  # noqa: B018
    return counted(b, steps.derivation_stats(b.stage))
