"""Sources, sinks and write-conflict forms."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from crateline.operators import corpus as C
from crateline.operators import relational as R
from crateline.plans import steps
from crateline.plans.staging import tune
from crateline.sources import files, readers, tables
from driver_binding import catalogue as B
from driver_binding.oracle import anew, hop
from driver_binding.registry import query

LINE_TEXT = "string_agg(concat(artist_id, ':', name, ':', coalesce(join_phrase, '-')), '|' ORDER BY position)"
CRED_TEXT = "string_agg(concat(artist_id, ':', name, ':', role), '|' ORDER BY position)"
LAB_TEXT = (
    "string_agg(concat(coalesce(CAST(label_id AS VARCHAR), '-'), ':', name, ':', coalesce(catno, '-')), "
    "'|' ORDER BY position)"
)


def _joined(array: str, *fields: str):
    cell = lambda r: F.concat_ws(":", *[F.coalesce(r[f].cast("string"), F.lit("-")) for f in fields])
    return F.array_join(F.transform(array, cell), "|")


def _folder(b, name: str) -> str:
    return f"{b.stage.folder}/{name}"


@query(
    "s1_read_releases",
    f"""SELECT n.id, n.title, n.year, l.artists, coalesce(c.credits, '') AS credits, b.labels,
        concat(n.segment, '|', 'Nation style ', n.nation) AS styles, n.genre AS genres
        FROM k_nested n
        JOIN (SELECT release_id, {LINE_TEXT} AS artists FROM k_n_line GROUP BY 1) l ON l.release_id = n.id
        LEFT JOIN (SELECT release_id, {CRED_TEXT} AS credits FROM k_n_cred GROUP BY 1) c ON c.release_id = n.id
        JOIN (SELECT release_id, {LAB_TEXT} AS labels FROM k_n_lab GROUP BY 1) b ON b.release_id = n.id""",
)
def read_releases(b):
    """A dump written from the orders, read back through the XML reader."""
    path = _folder(b, "releases_xml")
    readers.write_xml(readers.release_xml_rows(B.nested_releases(b.spark, b.sf_dir)), path, "releases", "release")
    return readers.read_releases(b.spark, path).select(
        "id",
        "title",
        "year",
        _joined("artists", "id", "name", "join_phrase").alias("artists"),
        _joined("credits", "id", "name", "role").alias("credits"),
        _joined("labels", "id", "name", "catno").alias("labels"),
        F.array_join("styles", "|").alias("styles"),
        F.array_join("genres", "|").alias("genres"),
    )


@query(
    "s2_read_artists",
    """SELECT id, name, real_name, profile, array_to_string(urls, '|') AS urls,
        array_to_string(list_transform(relations, lambda r: concat(r.kind, ':', r.id, ':', r.name)), '|')
        AS relations FROM k_adump_all WHERE id > 0""",
)
def read_artists(b):
    """Every part goes into the dump; the reader keeps records with an id above 0."""
    path = _folder(b, "artists_xml")
    readers.write_xml(readers.artist_xml_rows(b.whole_artists_dump), path, "artists", "artist")
    return readers.read_artists(b.spark, path).select(
        "id",
        "name",
        "real_name",
        "profile",
        F.array_join("urls", "|").alias("urls"),
        _joined("relations", "kind", "id", "name").alias("relations"),
    )


@query("s3_read_labels", "SELECT id, name, profile, array_to_string(urls, '|') AS urls FROM k_ldump_all WHERE id > 0")
def read_labels(b):
    path = _folder(b, "labels_xml")
    readers.write_xml(readers.label_xml_rows(b.whole_labels_dump), path, "labels", "label")
    return readers.read_labels(b.spark, path).withColumn("urls", F.array_join("urls", "|"))


TYPES = ("artists", "labels", "releases")


@query(
    "s4_latest_complete_snapshot",
    """SELECT strftime(o_orderdate, '%Y%m%d') AS date FROM orders
        WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND o_orderstatus <> 'P'
        GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = 3 ORDER BY 1 DESC LIMIT 1""",
)
def latest_complete_snapshot(b):
    """File names made from order dates: the priority tells the file type."""
    kind = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "artists")
        .when(F.col("o_orderpriority") == "2-HIGH", "labels")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "releases")
        .otherwise("masters")
    )
    suffix = F.when(F.col("o_orderstatus") == "P", ".xml.part").otherwise(".xml.gz")
    stamp = F.date_format("o_orderdate", "yyyyMMdd")
    files = B.read(b.spark, b.sf_dir, "orders").select(
        F.concat(F.lit("dump_"), stamp, F.lit("_"), kind, suffix).alias("name")
    )
    return readers.latest_complete_snapshot(files, TYPES)


@query("s5_sample_snapshot", "SELECT id, title, year FROM k_nested ORDER BY id LIMIT 5000")
def sample_snapshot(b):
    nested = B.nested_releases(b.spark, b.sf_dir).select("id", "title", "year")
    return readers.sample_snapshot(nested)


CORPUS_TABLES = """SELECT 'releases' AS tab, id AS release_id, CAST(NULL AS BIGINT) AS position, CAST(NULL AS BIGINT) AS ref_id, title AS detail FROM k_nested
        UNION ALL SELECT 'release_artists', release_id, position, artist_id, concat(name, coalesce(join_phrase, '')) FROM k_n_line
        UNION ALL SELECT 'release_credits', release_id, position, artist_id, concat(name, role) FROM k_n_cred
        UNION ALL SELECT 'release_labels', release_id, position, label_id, concat(name, coalesce(catno, '')) FROM k_n_lab
         WHERE label_id IS NOT NULL AND NOT starts_with(lower(ltrim(name)), 'not on label')
        UNION ALL SELECT 'release_styles', id, NULL, NULL, unnest([segment, concat('Nation style ', nation)]) FROM k_nested
        UNION ALL SELECT 'release_genres', id, NULL, NULL, genre FROM k_nested"""


@query("s6_write_corpus_tables", CORPUS_TABLES)
def write_corpus_tables(b):
    return _corpus_rows(b, "corpus_tables", B.nested_releases(b.spark, b.sf_dir))


@query("s6_repeated_records", CORPUS_TABLES)
def repeated_records(b):
    """Every record twice, first in another form: the last write of each stays."""
    last = B.nested_releases(b.spark, b.sf_dir).withColumn("written", F.lit(2))
    before = last.withColumn("title", F.lit("Before")).withColumn("styles", F.array(F.lit("Before")))
    before = before.withColumn("artists", F.concat("artists", "artists")).withColumn("written", F.lit(1))
    records = readers.last_records(before.unionByName(last), order=F.col("written"))
    return _corpus_rows(b, "repeated_records", records)


def _corpus_rows(b, folder: str, nested):
    path = _folder(b, folder)
    made = tables.corpus_tables(C.flatten(nested), b.dials)
    tables.rebuild(made, path)
    back = {name: b.spark.read.schema(df.schema).parquet(f"{path}/{name}") for name, df in made.items()}
    none = F.lit(None).cast("bigint")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    parts = [
        ("releases", F.col("id"), none, none, F.col("title")),
        ("release_artists", F.col("release_id"), F.col("position"), F.col("artist_id"), F.concat("name", text("join_phrase"))),
        ("release_credits", F.col("release_id"), F.col("position"), F.col("artist_id"), F.concat("name", "role")),
        ("release_labels", F.col("release_id"), F.col("position"), F.col("label_id"), F.concat("name", text("catno"))),
        ("release_styles", F.col("release_id"), none, none, F.col("style")),
        ("release_genres", F.col("release_id"), none, none, F.col("genre")),
    ]
    rows = None
    for name, release, position, ref, detail in parts:
        part = back[name].select(
            F.lit(name).alias("tab"), release.alias("release_id"), position.cast("bigint").alias("position"),
            ref.alias("ref_id"), detail.alias("detail"),
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows


SERVED = {
    "artists": "k_artists",
    "labels": "k_labels",
    "releases": "k_kept",
    "artist_collaborators": "k_collab",
    "label_roster": "k_alabels",
    "artist_coverage": "k_coverage",
    "corpus_artists": "k_corpus",
}


def _published(b):
    path = _folder(b, "serving")
    held = {name: b.tables[name] for name in (*SERVED, "label_artist_pairs", "seed_labels")}
    tables.publish_serving(held, path)
    return tables.load_serving(b.spark, path)


# Whole numbers of a served table, added up to tell its contents, beside its count.
DIGESTS = {
    "artists": ("id",),
    "labels": ("id",),
    "releases": ("id", "year"),
    "artist_collaborators": ("artist_id", "collaborator_id", "shared_releases"),
    "label_roster": ("label_id", "artist_id", "release_count", "first_year", "last_year"),
    "artist_coverage": ("artist_id", "release_count", "credited_releases", "collaborator_count"),
    "corpus_artists": ("artist_id",),
}


def digest_sql(name: str, source: str, columns) -> str:
    text = " || ':' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in columns)
    return f"""SELECT '{name}' AS tab, count(*) AS n,
        CAST(sum(CAST(concat('0x', md5({text})[1:8]) AS BIGINT)) AS BIGINT) AS digest FROM {source}"""


def digests(held, columns):
    """(tab, n, digest): rows of each table and a sum of checksums of what they hold."""
    rows = None
    for name, df in held.items():
        text = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns[name]))
        checksum = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")
        part = df.agg(F.count("*").alias("n"), F.sum(checksum).alias("digest")).select(F.lit(name).alias("tab"), "n", "digest")
        rows = part if rows is None else rows.unionByName(part)
    return rows


@query("s7_publish_serving", " UNION ALL ".join(digest_sql(name, SERVED[name], DIGESTS[name]) for name in SERVED))
def publish_serving(b):
    """Count and contents of what was published."""
    published = _published(b)
    return digests({name: published[name] for name in SERVED}, DIGESTS)


@query(
    "s8_run_log",
    """SELECT 'derive' AS step, 'orders.parquet' AS source_file, (SELECT count(*) FROM k_kept) AS releases,
        (SELECT count(*) FROM k_corpus) AS artists, CAST(6 AS BIGINT) AS dial
        UNION ALL SELECT 'pass2', NULL, (SELECT count(*) FROM k_kept),
        (SELECT count(*) FROM k_corpus), CAST(4 AS BIGINT)""",
)
def run_log(b):
    """What the steps counted while they wrote, logged without a job and read back."""
    # The log is added to, so each call keeps its own.
    path = _folder(b, f"runs-{uuid4().hex}")
    b.corpus  # noqa: B018 - counted when written
    stats = {"releases": b.stage.counts["releases"]["rows"], "artists": b.stage.counts["corpus_artists"]["rows"]}
    for step, source, dial in (("derive", "orders.parquet", 6), ("pass2", None, 4)):
        tables.append_run(b.spark, tables.run_record(stats, step, source, {"dial": dial}, "2026-01-01T00:00:00"), path)
    number = lambda text, key: F.get_json_object(text, f"$.{key}").cast("bigint")
    return tables.read_runs(b.spark, path).select(
        "step",
        "source_file",
        number("stats_json", "releases").alias("releases"),
        number("stats_json", "artists").alias("artists"),
        number("config_json", "dial").alias("dial"),
    )


@query(
    "s9_load_serving",
    """SELECT a.id, a.name, c.relevance, c.release_count FROM k_artists a
        JOIN k_coverage c ON c.artist_id = a.id""",
)
def load_serving(b):
    loaded = _published(b)
    coverage = loaded["artist_coverage"].withColumnRenamed("artist_id", "id")
    return loaded["artists"].select("id", "name").join(
        coverage.select("id", "relevance", "release_count"), "id"
    )


# --- write conflicts ------------------------------------------------------------------

WRITES = "l_shipdate {0}, l_extendedprice {0}, l_partkey {0}, l_suppkey {0}, l_quantity {0}, l_discount {0}, l_tax {0}"


def _writes(b):
    """Repeated writes of one (order, line number), later ones told by their other columns."""
    order = ["l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax"]
    return B.read(b.spark, b.sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.struct(*order).alias("seq")
    )


def _wins(direction: str) -> str:
    return f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey FROM (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY {WRITES.format(direction)}) AS rn FROM lineitem) WHERE rn = 1"""


@query("u1_replace_by_key", _wins("DESC"))
def replace_by_key(b):
    return R.replace_by_key(_writes(b), ["l_orderkey", "l_linenumber"], "seq").drop("seq")


@query("u2_ignore_by_key", _wins("ASC"))
def ignore_by_key(b):
    return R.ignore_by_key(_writes(b), ["l_orderkey", "l_linenumber"], ["seq"]).drop("seq")


@query(
    "u3_merge_flags",
    """SELECT id, CAST(is_seed AS BIGINT) AS is_seed, CAST(channel_a AS BIGINT) AS channel_a,
        CAST(channel_b AS BIGINT) AS channel_b FROM k_kept""",
)
def merge_flags(b):
    flags = b.corpus["channel_flags"].withColumnRenamed("release_id", "id")
    return R.merge_flags(b.seed.releases.select("id"), flags, "id", ("channel_a", "channel_b"))


@query("u4_count_by_key", "SELECT style, count(*) AS occurrences FROM k_sty GROUP BY 1")
def count_by_key(b):
    return R.count_by_key(b.cat.styles, "style")


_FLAGS = """SELECT '{0}' AS run, artist_id, CAST(is_seed AS BIGINT) AS is_seed, CAST(channel_a AS BIGINT) AS channel_a,
        CAST(channel_b AS BIGINT) AS channel_b FROM {1}"""


@query(
    "u5_rebuild_not_layer",
    _FLAGS.format("given", "k_corpus") + " UNION ALL " + _FLAGS.format("wider", "k_wide_corpus"),
    anew("wide", hop(B.WIDER)),
)
def rebuild_not_layer(b):
    """Two expansions with other dials from one stored seed, each in a session of its own; the
    second leaves the seed as it is, and a rerun of the first replaces what it owns."""
    folder = _folder(b, f"store-{uuid4().hex}")
    source = files.listing_digest(b.spark, *(f"{b.sf_dir}/{t}.parquet" for t in ("orders", "lineitem", "part", "supplier")))
    steps.select_seed(b.cat, b.dials, steps.open_store(b.spark, folder, b.dials, catalogue=source))
    rows = None
    for run, dials in (("given", b.dials), ("wider", B.WIDER), ("given", b.dials)):
        session = tune(b.spark.newSession())
        cat = B.catalogue({n: session.read.schema(df.schema).parquet(_folder(b, n)) for n, df in b.cat_tables.items()})
        store = steps.open_store(session, folder, dials, catalogue=source)
        seed = steps.load_seed(store)
        if rows is not None and run == "given":
            store.clear("corpus_artists")
        steps.expand(cat, seed, dials, store)
        if rows is None or run == "wider":
            held = steps.open_store(b.spark, folder, dials, catalogue=source).need("corpus_artists")["corpus_artists"]
            rows = held.withColumn("run", F.lit(run)) if rows is None else rows.unionByName(held.withColumn("run", F.lit(run)))
    return rows
