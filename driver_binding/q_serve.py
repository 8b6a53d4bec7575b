"""Ranked serving queries, in the form that answers for every entity at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from crateline.config import PAGE_SIZE
from crateline.operators import serve as V
from crateline.plans import steps
from driver_binding.oracle import BAND_RANK, SC, sql_list
from driver_binding.registry import query


@query(
    "q1_artist_profile",
    """SELECT a.id, a.name, a.real_name, a.profile, coalesce(array_to_string(a.urls, chr(10)), '') AS urls,
        coalesce(c.release_count, 0) AS release_count, coalesce(c.credited_releases, 0) AS credited_releases,
        coalesce(c.collaborator_count, 0) AS collaborator_count, coalesce(c.label_count, 0) AS label_count,
        c.first_year, c.last_year, CAST(coalesce(m.is_seed, false) AS BIGINT) AS is_seed,
        CAST(coalesce(m.channel_a, false) AS BIGINT) AS channel_a,
        CAST(coalesce(m.channel_b, false) AS BIGINT) AS channel_b,
        coalesce(c.relevance, 'none') AS relevance, coalesce(c.scene_relevance, 'none') AS scene_relevance,
        coalesce(c.seed_releases, 0) AS seed_releases, c.seed_share, c.lineage
        FROM k_artists a LEFT JOIN k_coverage c ON c.artist_id = a.id LEFT JOIN k_corpus m ON m.artist_id = a.id""",
)
def artist_profile(b):
    return V.artist_profile(b.tables)


@query(
    "q2_top_collaborators",
    """SELECT * FROM (SELECT c.artist_id, row_number() OVER (PARTITION BY c.artist_id
        ORDER BY shared_releases DESC, a.name, c.collaborator_id) AS place, c.collaborator_id, a.name,
        c.shared_releases, c.roles FROM k_collab c JOIN k_artists a ON a.id = c.collaborator_id)
        WHERE place <= 100""",
)
def top_collaborators(b):
    return V.top_collaborators(b.tables)


@query(
    "q3_ranked_artist_labels",
    """SELECT artist_id, label_id, l.name, release_count, first_year, last_year
        FROM k_alabels JOIN k_labels l ON l.id = label_id""",
)
def ranked_artist_labels(b):
    return V.ranked_artist_labels(b.tables)


@query(
    "q4_label_profile",
    """SELECT l.id, l.name, l.profile, coalesce(array_to_string(l.urls, chr(10)), '') AS urls,
        (SELECT count(*) FROM k_alabels r WHERE r.label_id = l.id) AS artist_count, t.n AS release_count,
        coalesce(g.relevance, 'none') AS relevance, g.seed_ratio,
        CAST(t.n > 1 AND coalesce(s.top = t.n, false) AS BIGINT) AS is_imprint, s.first_year, s.last_year
        FROM k_labels l JOIN (SELECT label_id, count(DISTINCT release_id) AS n FROM k_c_lab GROUP BY 1) t
          ON t.label_id = l.id
        LEFT JOIN (SELECT label_id, max(release_count) AS top, min(first_year) AS first_year,
                   max(last_year) AS last_year FROM k_alabels GROUP BY 1) s ON s.label_id = l.id
        LEFT JOIN k_lcov g ON g.label_id = l.id""",
)
def label_profile(b):
    return V.label_profile(b.tables)


@query(
    "q5_top_roster",
    """SELECT * FROM (SELECT label_id, row_number() OVER (PARTITION BY label_id
        ORDER BY release_count DESC, a.name, artist_id) AS place, artist_id, a.name, release_count,
        first_year, last_year FROM k_alabels JOIN k_artists a ON a.id = artist_id) WHERE place <= 200""",
)
def top_roster(b):
    return V.top_roster(b.tables)


@query(
    "q6_artist_releases",
    """SELECT m.artist_id, m.place, m.release_id, m.title, m.year, l.name AS label, l.label_id, r.roles FROM (
          SELECT artist_id, release_id, title, year, row_number() OVER (PARTITION BY artist_id
            ORDER BY year DESC NULLS LAST, title, release_id) AS place
          FROM (SELECT artist_id, release_id FROM k_c_line UNION SELECT artist_id, release_id FROM k_c_cred)
          JOIN k_kept ON id = release_id) m
        LEFT JOIN (SELECT release_id, label_id, name, row_number() OVER (PARTITION BY release_id
            ORDER BY position, label_id, name) AS rn FROM k_c_lab) l ON l.release_id = m.release_id AND l.rn = 1
        LEFT JOIN (SELECT artist_id, release_id, string_agg(DISTINCT role, ',' ORDER BY role) AS roles
            FROM k_c_cred GROUP BY 1, 2) r ON r.artist_id = m.artist_id AND r.release_id = m.release_id
        WHERE m.place <= 300""",
)
def artist_releases(b):
    return V.artist_releases(b.served)


@query(
    "q7_label_releases",
    """SELECT m.label_id, m.place, m.release_id, m.title, m.year, m.catno, y.by_line FROM (
          SELECT label_id, release_id, title, year, catno, row_number() OVER (PARTITION BY label_id
            ORDER BY year DESC NULLS LAST, title, release_id) AS place
          FROM (SELECT label_id, release_id, catno, row_number() OVER (PARTITION BY label_id, release_id
                ORDER BY position, catno NULLS FIRST) AS rn FROM k_c_lab)
          JOIN k_kept ON id = release_id WHERE rn = 1) m
        LEFT JOIN (SELECT release_id, string_agg(name, ' ' ORDER BY position, name) AS by_line
            FROM k_c_line GROUP BY 1) y ON y.release_id = m.release_id
        WHERE m.place <= 300""",
)
def label_releases(b):
    return V.label_releases(b.served)


@query(
    "q8_relations",
    """SELECT DISTINCT t.artist_id, t.other_id, t.kind, coalesce(a.name, t.related_name) AS name,
        coalesce(c.release_count, 0) AS release_count, CAST(m.artist_id IS NOT NULL AS BIGINT) AS in_corpus
        FROM (SELECT artist_id, related_id AS other_id, kind, related_name FROM k_relations
              UNION ALL SELECT related_id, artist_id, CASE kind WHEN 'member' THEN 'group'
                WHEN 'group' THEN 'member' ELSE 'alias' END, NULL FROM k_relations) t
        LEFT JOIN k_artists a ON a.id = t.other_id LEFT JOIN k_coverage c ON c.artist_id = t.other_id
        LEFT JOIN k_corpus m ON m.artist_id = t.other_id
        WHERE coalesce(a.name, t.related_name, '') <> ''""",
)
def relations(b):
    return V.relations(b.tables)


@query(
    "q9_search",
    """SELECT *, CAST((SELECT max(n) = 40 FROM (SELECT count(*) AS n FROM k_hits GROUP BY kind)) AS BIGINT)
        AS truncated FROM k_hits""",
    {
        "k_hits": """SELECT * FROM (SELECT 'artist' AS kind, s.id, s.name, coalesce(c.release_count, 0) AS release_count,
            coalesce(c.relevance, 'none') AS relevance,
            CASE WHEN channel_a AND channel_b THEN 'collaborator + label mate' WHEN channel_a THEN 'collaborator'
                 WHEN channel_b THEN 'label mate' END AS connection
            FROM k_asearch s LEFT JOIN k_coverage c ON c.artist_id = s.id LEFT JOIN k_corpus m ON m.artist_id = s.id
            WHERE contains(norm, ' red wi')
            ORDER BY coalesce(is_seed, false) DESC, release_count DESC, s.id LIMIT 40)
            UNION ALL SELECT * FROM (SELECT 'label' AS kind, s.id, s.name, t.n AS release_count,
            coalesce(g.relevance, 'none') AS relevance, NULL AS connection
            FROM k_lsearch s JOIN (SELECT label_id, count(DISTINCT release_id) AS n FROM k_c_lab GROUP BY 1) t
              ON t.label_id = s.id LEFT JOIN k_lcov g ON g.label_id = s.id
            WHERE contains(norm, ' red wi') ORDER BY release_count DESC, s.id LIMIT 40)"""
    },
)
def search(b):
    return V.search(b.served, ' Réd-"Wi')


@query(
    "q10_alias_expansion",
    "SELECT id, CAST(0 AS BIGINT) AS band FROM k_core_alias UNION ALL SELECT id, CAST(1 AS BIGINT) FROM k_named_alias",
)
def alias_expansion(b):
    rows, scene = b.entities["artist_relations"], b.dials.scene
    near = lambda ids, band: V.alias_expansion(rows, ids).withColumn("band", F.lit(band))
    return near(scene.core_artists, 0).unionByName(near(scene.named_artists, 1))


@query("q11_scene_releases", "SELECT release_id FROM k_scene")
def scene_releases(b):
    who = V.anchors(b.entities["artist_relations"], b.dials.scene)
    return V.scene_releases(b.tables, b.dials.scene, who)


@query("q12_standing", "SELECT id, name, standing, scene_releases, line_releases FROM k_standings")
def standing(b):
    return V.scene_standings(b.tables, b.dials.scene)


TOP_ARTISTS = "SELECT id, name, standing, scene_releases, line_releases, weight FROM k_top_artists"


@query(
    "q13_top_artists",
    """SELECT t.id, t.name, t.standing, t.scene_releases, t.line_releases, t.weight, c.first_year, c.last_year
        FROM k_top_artists t LEFT JOIN k_coverage c ON c.artist_id = t.id""",
)
def top_artists(b):
    return V.top_artists(b.tables, b.dials.scene)


@query(
    "q14_top_labels",
    f"""SELECT * FROM (SELECT l.id, l.name,
          CASE WHEN l.id IN {sql_list(SC.scene_labels)} THEN 'core' ELSE 'found' END AS standing,
          t.releases, t.scene_releases, coalesce(b.core_artists, 0) AS core_artists,
          coalesce(b.named_artists, 0) AS named_artists,
          (3 * coalesce(b.core_artists, 0) + coalesce(b.named_artists, 0)) * (t.scene_releases / t.releases) AS weight,
          v.first_year, v.last_year
        FROM (SELECT label_id, count(DISTINCT release_id) AS releases,
                count(DISTINCT CASE WHEN release_id IN (SELECT release_id FROM k_scene) THEN release_id END) AS scene_releases
              FROM k_c_lab GROUP BY 1) t
        JOIN k_labels l ON l.id = t.label_id
        LEFT JOIN (SELECT label_id, count(DISTINCT CASE WHEN standing = 'core' THEN artist_id END) AS core_artists,
                count(DISTINCT CASE WHEN standing = 'named' THEN artist_id END) AS named_artists
              FROM k_c_lab JOIN k_c_line USING (release_id)
              JOIN (SELECT id AS artist_id, standing FROM k_top_artists WHERE standing <> 'found') USING (artist_id)
              GROUP BY 1) b ON b.label_id = l.id
        LEFT JOIN (SELECT label_id, min(first_year) AS first_year, max(last_year) AS last_year
              FROM k_alabels GROUP BY 1) v ON v.label_id = l.id)
        WHERE weight > 0 OR standing = 'core'
        ORDER BY {BAND_RANK.format('standing')}, weight DESC, name, id LIMIT 1000""",
)
def top_labels(b):
    return steps.top_lists(b.tables, b.dials.scene, b.stage)["top_labels"]


@query(
    "q15_page",
    f"""SELECT 'ranking' AS sort, id, name, greatest(0, (SELECT count(*) FROM k_top_artists) - 120) AS remaining
        FROM (SELECT * FROM k_top_artists ORDER BY {BAND_RANK.format('standing')}, weight DESC, name, id LIMIT 120)
        UNION ALL SELECT 'name', id, name, greatest(0, (SELECT count(*) FROM k_top_artists) - 40)
        FROM (SELECT * FROM k_top_artists ORDER BY name, id LIMIT 40)""",
)
def page(b):
    """The second page of the ranking, and the first page of the same list by name."""
    listed = steps.top_lists(b.tables, b.dials.scene, b.stage)["top_artists"]
    total = listed.count()
    order = [V.band_rank(F.col("standing")), F.col("weight").desc(), F.col("name"), F.col("id")]
    ranked, left = V.page(listed, PAGE_SIZE * 3, order, total)
    by_name, left_by_name = V.page(listed, "12", order, total, sort="name")
    shown = lambda df, sort, n: df.select(
        F.lit(sort).alias("sort"), "id", "name", F.lit(n).alias("remaining")
    )
    return shown(ranked, "ranking", left).unionByName(shown(by_name, "name", left_by_name))


@query(
    "q16_corpus_stats",
    """SELECT (SELECT count(*) FROM k_artists) AS artists, (SELECT count(*) FROM k_labels) AS labels,
        (SELECT count(*) FROM k_kept) AS releases""",
)
def corpus_stats(b):
    return V.corpus_stats(b.tables)
