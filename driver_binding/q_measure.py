"""Measuring the dials and accepting a corpus."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from crateline.operators import corpus as C
from crateline.operators import measure as M
from crateline.plans.totals import refresh_totals, store_totals
from driver_binding import catalogue as B
from driver_binding.registry import query

SHARES = """SELECT artist_id, seed_releases, total, seed_releases / total AS share
        FROM k_seed_art JOIN k_totals USING (artist_id)"""
FLOORS = (0.2, 0.3, 0.4, 0.5)

# (cached rows counted or not, built from, dump on disk, forced) and what must follow.
CASES = (
    ("same", "a.xml.gz", "a.xml.gz", False),
    ("newer", "a.xml.gz", "b.xml.gz", False),
    ("unknown", None, "a.xml.gz", False),
    ("no dump", "a.xml.gz", None, False),
    ("forced", "a.xml.gz", "a.xml.gz", True),
)


@query(
    "m1_totals_cache_verdict",
    """SELECT state, action, CASE state WHEN 'same' THEN CASE WHEN n > 0 THEN 'uncovered' ELSE 'current' END
          ELSE why END AS why, built_from, dump_on_disk, n AS uncovered
        FROM (SELECT *, CASE state WHEN 'same' THEN CASE WHEN n > 0 THEN 'rescan' ELSE 'reuse' END ELSE told END AS action
          FROM k_uncovered, (VALUES
            ('same', NULL, NULL, 'a.xml.gz', 'a.xml.gz'),
            ('newer', 'rescan', 'other dump', 'a.xml.gz', 'b.xml.gz'),
            ('unknown', 'rescan', 'unrecorded', NULL, 'a.xml.gz'),
            ('no dump', 'reuse', 'unchecked', 'a.xml.gz', NULL),
            ('forced', 'rescan', 'forced', 'a.xml.gz', 'a.xml.gz')) t(state, told, why, built_from, dump_on_disk))""",
    {
        "k_uncovered": """SELECT count(*) AS n FROM k_seed_art
        WHERE artist_id NOT IN (SELECT artist_id FROM k_totals WHERE total >= 25)"""
    },
)
def totals_cache_verdict(b):
    """A cache that misses the artists with few appearances, in each state it may be found in."""
    cache = b.seed.totals.filter("total >= 25")
    verdicts = None
    for name, built_from, on_disk, forced in CASES:
        held = M.totals_cache_state(cache, b.seed.artists, built_from, on_disk, forced)
        row = M.totals_cache_verdict(held).select(F.lit(name).alias("state"), "*")
        verdicts = row if verdicts is None else verdicts.unionByName(row)
    return verdicts


@query(
    "m1_stored_totals",
    """SELECT state, action, CAST(coalesce(CASE action WHEN 'reuse' THEN kept ELSE whole END, 0) AS BIGINT) AS total, CAST(n AS BIGINT) AS artists
        FROM (SELECT state, action, sum(CASE WHEN old THEN t.total END) AS kept, sum(t.total) AS whole,
            CASE action WHEN 'reuse' THEN count(*) FILTER (old) ELSE count(*) END AS n
          FROM (SELECT *, total >= 25 AS old FROM k_totals WHERE artist_id IN (SELECT artist_id FROM k_seed_art)) t,
            (SELECT state, CASE state WHEN 'same' THEN CASE WHEN n > 0 THEN 'rescan' ELSE 'reuse' END ELSE told END AS action
             FROM k_uncovered, (VALUES ('same', NULL), ('newer', 'rescan'), ('unknown', 'rescan'), ('no dump', 'reuse'),
               ('forced', 'rescan')) v(state, told)) GROUP BY state, action)""",
    {
        "k_uncovered": """SELECT count(*) AS n FROM k_seed_art
        WHERE artist_id NOT IN (SELECT artist_id FROM k_totals WHERE total >= 25)"""
    },
)
def stored_totals(b):
    """Totals stored without artists of few appearances, in each state, and what acting on it leaves."""
    few = b.seed.totals.filter("total >= 25").join(b.seed.artists.select("artist_id"), "artist_id", "left_semi")
    rows = None
    for name, built_from, on_disk, forced in CASES:
        folder = f"{b.stage.folder}/totals-{uuid4().hex}"
        store_totals(few, folder, built_from)
        scan = lambda: C.appearance_counts(C.appearances(b.cat))
        made = refresh_totals(folder, b.seed.artists, scan, on_disk, forced)
        row = made.totals.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.count("*").alias("artists"))
        row = row.select(F.lit(name).alias("state"), F.lit(made.verdict["action"]).alias("action"), "total", "artists")
        rows = row if rows is None else rows.unionByName(row)
    return rows


BAND = """CASE WHEN share < 0.02 THEN 'a) under 2%' WHEN share < 0.05 THEN 'b) 2-5%'
        WHEN share < 0.10 THEN 'c) 5-10%' WHEN share < 0.25 THEN 'd) 10-25%'
        WHEN share < 0.50 THEN 'e) 25-50%' ELSE 'f) 50%+' END"""


@query(
    "m2_share_bands",
    f"""SELECT band, count(*) AS n, 100.0 * count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM k_tally JOIN k_totals
        USING (artist_id)) AS pct FROM (SELECT {BAND} AS band FROM (SELECT seed_releases / total AS share
        FROM k_tally JOIN k_totals USING (artist_id))) GROUP BY 1""",
)
def share_bands(b):
    """Over every candidate, which spreads wider than those the ratio kept."""
    return M.share_bands(b.seed.tally, b.seed.totals)


@query(
    "m3_largest_catalogues",
    """SELECT s.artist_id, a.name, seed_releases, total, share FROM k_shares s JOIN k_artists a ON a.id = s.artist_id
        ORDER BY total DESC, s.artist_id LIMIT 12""",
    {"k_shares": SHARES},
)
def largest_catalogues(b):
    return M.largest_catalogues(b.seed.artists, b.seed.totals, b.entities["artists"])


def _sweep(floors: str) -> str:
    return f"""SELECT t.floor, a.artists, coalesce(l.labels, 0) AS labels
        FROM (SELECT CAST(unnest({floors}) AS DOUBLE) AS floor) t
        JOIN (SELECT f.floor, count(share) AS artists FROM (SELECT CAST(unnest({floors}) AS DOUBLE) AS floor) f
          LEFT JOIN k_shares ON share >= f.floor GROUP BY 1) a ON a.floor = t.floor
        LEFT JOIN (SELECT floor, count(*) AS labels FROM (
            SELECT f.floor, p.label_id, p.roster, count(*) AS strong
            FROM (SELECT CAST(unnest({floors}) AS DOUBLE) AS floor) f
            JOIN (SELECT label_id, share, count(*) OVER (PARTITION BY label_id) AS roster
                  FROM k_pairs LEFT JOIN k_shares USING (artist_id)) p ON p.share >= f.floor GROUP BY ALL)
          WHERE strong >= 2 AND strong / roster >= 0.25 GROUP BY 1) l ON l.floor = t.floor"""


@query("m4_floor_sweep", _sweep(str(list(FLOORS))), {"k_shares": SHARES})
def floor_sweep(b):
    return M.floor_sweep(b.seed.artists, b.seed.totals, b.seed.pairs, FLOORS, 2, 0.25)


@query("m4_thousand_floors", _sweep("list_transform(range(1, 1001), lambda i: i / 1000)"), {"k_shares": SHARES})
def thousand_floors(b):
    """As many floors as there are steps of a thousandth, still one pass."""
    return M.floor_sweep(b.seed.artists, b.seed.totals, b.seed.pairs, [i / 1000 for i in range(1, 1001)], 2, 0.25)


@query(
    "m5_top_seed_labels",
    """SELECT label_id, seed_artist_count, total_artist_count, seed_ratio, name FROM k_seed_lab
        LEFT JOIN (SELECT label_id, min(name) AS name FROM k_c_lab GROUP BY 1) USING (label_id)
        ORDER BY seed_artist_count DESC, seed_ratio DESC, label_id LIMIT 15""",
)
def top_seed_labels(b):
    return M.top_seed_labels(b.seed.labels, b.corpus["release_labels"])


@query(
    "m6_retune_seed_labels",
    """SELECT label_id, seeds AS seed_artist_count, total AS total_artist_count, seeds / total AS seed_ratio
        FROM k_label_counts WHERE seeds >= 5 AND seeds / total >= 0.42""",
)
def retune_seed_labels(b):
    return M.retune_seed_labels(b.seed.pairs, b.seed.artists, 5, 0.42)


FACTS = """SELECT a.name, 'in corpus' AS predicate, '' AS argument FROM k_artists a JOIN k_corpus c ON c.artist_id = a.id
        UNION SELECT a.name, 'is core', '' FROM k_artists a JOIN k_corpus c ON c.artist_id = a.id WHERE is_seed
        UNION SELECT l.name, 'is seed label', '' FROM k_labels l JOIN k_seed_lab s ON s.label_id = l.id
        UNION SELECT a.name, 'is high', '' FROM k_artists a JOIN k_coverage c ON c.artist_id = a.id WHERE relevance = 'high'
        UNION SELECT a.name, 'has lineage', lineage FROM k_artists a JOIN k_coverage c ON c.artist_id = a.id
          WHERE lineage IS NOT NULL
        UNION SELECT a.name, 'any lineage', '' FROM k_artists a JOIN k_coverage c ON c.artist_id = a.id
          WHERE lineage IS NOT NULL
        UNION SELECT a.name, 'at least medium', '' FROM k_artists a JOIN k_coverage c ON c.artist_id = a.id
          WHERE relevance IN ('high', 'medium')
        UNION SELECT a.name, 'is low', '' FROM k_artists a JOIN k_coverage c ON c.artist_id = a.id WHERE relevance = 'low'"""
ASKED = """SELECT 'label' AS kind, s_name AS name, 'is seed label' AS predicate, '' AS argument, s_nationkey < 12 AS want
        FROM supplier
        UNION ALL SELECT DISTINCT 'artist', p_name, p.predicate, p.argument, p_name < 'm' FROM part,
        (VALUES ('in corpus', ''), ('is core', ''), ('is high', ''), ('has lineage', 'one tag'), ('any lineage', ''),
                ('at least medium', ''), ('is low', '')) AS p(predicate, argument)"""


def _expectations(b):
    """Every supplier asked for as a seed label, every part name asked each artist question."""
    labels = B.read(b.spark, b.sf_dir, "supplier").select(
        F.lit("label").alias("kind"),
        F.col("s_name").alias("name"),
        F.lit("is seed label").alias("predicate"),
        F.lit(None).cast("string").alias("argument"),
        (F.col("s_nationkey") < 12).alias("want"),
    )
    asked = [
        ("in corpus", None), ("is core", None), ("is high", None), ("has lineage", "one tag"),
        ("any lineage", None), ("at least medium", None), ("is low", None),
    ]
    each = F.inline(
        F.array(*[F.struct(F.lit(p).alias("predicate"), F.lit(a).cast("string").alias("argument")) for p, a in asked])
    )
    names = B.read(b.spark, b.sf_dir, "part").select("p_name").distinct()
    artists = names.select("p_name", each).select(
        F.lit("artist").alias("kind"), F.col("p_name").alias("name"), "predicate", "argument",
        (F.col("p_name") < "m").alias("want"),
    )
    return labels.unionByName(artists)


@query(
    "m7_check_corpus",
    """SELECT a.kind, a.name, a.predicate, a.argument, CAST(a.want AS BIGINT) AS want,
        CAST(f.name IS NOT NULL AS BIGINT) AS got,
        CASE WHEN a.want = (f.name IS NOT NULL) THEN 'ok' ELSE 'FAIL' END AS ok
        FROM k_asked a LEFT JOIN k_facts f ON f.name = a.name AND f.predicate = a.predicate AND f.argument = a.argument""",
    {"k_facts": FACTS, "k_asked": ASKED},
)
def check_corpus(b):
    e, d, asked = b.entities, b.derived, _expectations(b)
    facts = M.named_facts(
        e["artists"], b.corpus["corpus_artists"], d["artist_coverage"], e["labels"], b.seed.labels, asked
    )
    return M.check_corpus(asked, facts)


@query(
    "m8_high_equals_seed",
    """SELECT (SELECT count(*) FROM k_lcov WHERE relevance = 'high') AS high,
        (SELECT count(*) FROM k_seed_lab) AS seed,
        CAST((SELECT count(*) FROM k_lcov WHERE relevance = 'high') = (SELECT count(*) FROM k_seed_lab) AS BIGINT) AS ok""",
)
def high_equals_seed(b):
    return M.high_equals_seed(b.derived["label_coverage"], b.seed.labels)


@query(
    "m9_absence_report",
    """SELECT 'no credits recorded' AS status, count(*) AS artists FROM k_coverage
        WHERE release_count > 0 AND credited_releases = 0
        UNION ALL SELECT 'worked alone', count(*) FROM k_coverage
        WHERE credited_releases > 0 AND collaborator_count = 0""",
)
def absence_report(b):
    return M.absence_report(b.derived["artist_coverage"])


@query(
    "m10_random_sample",
    "SELECT name FROM k_artists ORDER BY md5(concat('42:', id)), id LIMIT 5",
)
def random_sample(b):
    """A draw by a seeded hash."""
    return M.random_sample(b.entities["artists"], 5, 42)
