"""Predicates and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from crateline.config import SeedRule
from crateline.functions import predicates as P
from crateline.functions import text as T
from crateline.operators import corpus as C
from crateline.operators import serve as V
from driver_binding import catalogue as B
from driver_binding.oracle import GRADE_RANK, PLACEHOLDER_LABEL, REAL_PERSON, SC, grade_artist, grade_label, marker, sql_list
from driver_binding.registry import query

NESTED_RULE = SeedRule(
    core=("BUILDING",),
    broad=("Nation style 3", "FURNITURE"),
    gate_genres=("1-URGENT", "2-HIGH"),
    needs_companion=("MACHINERY",),
    companions=("Nation style 4", "Nation style 5"),
    disqualifying=("Nation style 7", "Nation style 8"),
)


@query(
    "p1_is_seed_release",
    """SELECT id, CAST(CASE WHEN nation IN (7, 8) THEN false WHEN segment = 'BUILDING' THEN true
        WHEN genre NOT IN ('1-URGENT', '2-HIGH') THEN false
        WHEN nation = 3 OR segment = 'FURNITURE' THEN true
        ELSE segment = 'MACHINERY' AND nation IN (4, 5) END AS BIGINT) AS is_seed FROM k_nested""",
)
def is_seed_release(b):
    nested = B.nested_releases(b.spark, b.sf_dir)
    return nested.select(
        "id", P.is_seed_release(F.col("styles"), F.col("genres"), NESTED_RULE).alias("is_seed")
    )


def _role_flag(name: str, markers, test):
    @query(
        name,
        f"""SELECT artist_id, release_id, role, CAST({marker('role', markers)} AS BIGINT) AS flag FROM k_cred""",
    )
    def made(b):
        return b.cat.credits.select("artist_id", "release_id", "role", test(F.col("role"), markers).alias("flag"))


_role_flag("p2_is_packaging_role", B.DIALS.packaging_roles, P.is_packaging_role)
_role_flag("p3_is_authorship_role", B.DIALS.authorship_roles, P.is_authorship_role)


@query(
    "p4_is_placeholder_artist",
    f"SELECT DISTINCT artist_id, name, CAST(NOT ({REAL_PERSON}) AS BIGINT) AS placeholder FROM k_app",
)
def is_placeholder_artist(b):
    flag = P.is_placeholder_artist(
        F.col("artist_id"), F.col("name"), b.dials.placeholder_ids, b.dials.placeholder_names
    )
    return C.appearances(b.cat).select("artist_id", "name", flag.alias("placeholder")).distinct()


@query(
    "p5_is_placeholder_label",
    f"SELECT name, CAST({PLACEHOLDER_LABEL} AS BIGINT) AS placeholder, count(*) AS refs FROM k_lab GROUP BY 1, 2",
)
def is_placeholder_label(b):
    flag = P.is_placeholder_label(F.col("name"), b.dials.placeholder_label_prefix)
    return b.cat.label_refs.groupBy("name", flag.alias("placeholder")).agg(F.count("*").alias("refs"))


@query(
    "p6_not_a_person",
    f"""SELECT id, name FROM k_artists WHERE id NOT IN {sql_list(SC.excluded_ids)}
        AND name NOT IN {sql_list(SC.excluded_names)}""",
)
def not_a_person(b):
    scene = b.dials.scene
    keep = P.not_a_listed_stand_in(F.col("id"), F.col("name"), scene.excluded_ids, scene.excluded_names)
    return b.entities["artists"].select("id", "name").filter(keep)


@query(
    "p7_usable_label",
    f"""SELECT count(*) FILTER (WHERE label_id IS NULL) AS labels_without_id,
        count(*) FILTER (WHERE label_id IS NOT NULL AND {PLACEHOLDER_LABEL}) AS placeholder_labels,
        (SELECT count(*) FROM k_usable) AS usable_labels FROM k_lab""",
)
def usable_label(b):
    return C.label_ref_stats(b.cat.label_refs, b.dials)


@query(
    "p8_parse_year",
    """SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN year(o_orderdate)
        WHEN '2-HIGH' THEN year(o_orderdate) WHEN '3-MEDIUM' THEN year(o_orderdate) END AS year FROM orders""",
)
def parse_year(b):
    """Years, padded dates and day-less dates parse; early years and words do not."""
    year = F.year("o_orderdate").cast("string")
    raw = (
        F.when(F.col("o_orderpriority") == "1-URGENT", year)
        .when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit("  "), year, F.lit("-03-00")))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("0"), F.substring(year, 2, 3)))
        .otherwise(F.concat(F.lit("c. "), year))
    )
    orders = B.read(b.spark, b.sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("id"), P.parse_year(raw).alias("year"))


@query(
    "p9_connection",
    """SELECT artist_id, CASE WHEN channel_a AND channel_b THEN 'collaborator + label mate'
        WHEN channel_a THEN 'collaborator' WHEN channel_b THEN 'label mate' END AS connection FROM k_corpus""",
)
def connection(b):
    return b.corpus["corpus_artists"].select(
        "artist_id", P.connection(F.col("channel_a"), F.col("channel_b")).alias("connection")
    )


@query(
    "p10_grade_artist",
    f"""SELECT artist_id, {grade_artist('seed_releases', 'seed_releases / nullif(total_releases, 0)')} AS grade
        FROM k_corpus LEFT JOIN k_seed_art USING (artist_id)""",
)
def grade_artist_query(b):
    people = b.corpus["corpus_artists"].select("artist_id").join(b.seed.artists, "artist_id", "left")
    share = F.col("seed_releases") / F.nullif(F.col("total_releases"), F.lit(0))
    return people.select("artist_id", P.grade_artist(F.col("seed_releases"), share, b.dials.grades).alias("grade"))


@query(
    "p11_grade_label",
    f"SELECT label_id, seeds, total, {grade_label('seeds', 'total')} AS grade FROM k_label_counts",
)
def grade_label_query(b):
    counts = C.label_seed_counts(b.seed.pairs, b.seed.artists)
    return counts.select(
        "label_id", "seeds", "total", P.grade_label(F.col("seeds"), F.col("total"), b.dials.grades).alias("grade")
    )


ABSENCE = """CASE WHEN collaborator_count > 0 THEN 'has collaborators' WHEN release_count = 0 THEN 'no releases'
        WHEN credited_releases = 0 THEN 'no credits recorded' ELSE 'worked alone' END"""


@query("p12_absence_status", f"SELECT artist_id, {ABSENCE} AS status FROM k_coverage")
def absence_status(b):
    c = F.col
    return b.derived["artist_coverage"].select(
        "artist_id",
        P.absence_status(c("release_count"), c("credited_releases"), c("collaborator_count")).alias("status"),
    )


@query(
    "p13_is_imprint",
    """SELECT label_id, n, top, CAST(n > 1 AND n = top AS BIGINT) AS is_imprint FROM
        (SELECT label_id, count(DISTINCT release_id) AS n FROM k_c_lab GROUP BY 1)
        JOIN (SELECT label_id, max(release_count) AS top FROM k_alabels GROUP BY 1) USING (label_id)""",
)
def is_imprint(b):
    releases = b.corpus["release_labels"].groupBy("label_id").agg(F.countDistinct("release_id").alias("n"))
    top = b.derived["label_roster"].groupBy("label_id").agg(F.max("release_count").alias("top"))
    return releases.join(top, "label_id").withColumn("is_imprint", P.is_imprint(F.col("n"), F.col("top")))


@query(
    "p14_lifted",
    """SELECT artist_id, CAST(lineage IS NOT NULL AND relevance <> scene_relevance AS BIGINT) AS lifted
        FROM k_coverage""",
)
def lifted(b):
    flag = P.lifted(F.col("lineage"), F.col("relevance"), F.col("scene_relevance"))
    return b.derived["artist_coverage"].select("artist_id", flag.alias("lifted"))


@query(
    "p15_grade_rank",
    f"SELECT label_id, relevance, CAST({GRADE_RANK.format('relevance')} AS BIGINT) AS place FROM k_lcov",
)
def grade_rank(b):
    return b.derived["label_coverage"].select(
        "label_id", "relevance", P.grade_rank(F.col("relevance")).alias("place")
    )


@query(
    "p16_share_span_count",
    """SELECT artist_id,
        CASE WHEN seed_share IS NULL THEN NULL
             WHEN floor(seed_share * 100 + 0.5) = 0 AND seed_share > 0 THEN '<1%'
             ELSE concat(CAST(floor(seed_share * 100 + 0.5) AS BIGINT), '%') END AS share,
        CASE WHEN first_year IS NULL AND last_year IS NULL THEN ''
             WHEN first_year = last_year THEN CAST(first_year AS VARCHAR)
             ELSE concat(coalesce(CAST(first_year AS VARCHAR), '?'), ' – ', coalesce(CAST(last_year AS VARCHAR), '?'))
        END AS years,
        CASE len(said) WHEN 0 THEN NULL WHEN 1 THEN said[1]
             ELSE concat(array_to_string(said[1:-2], ', '), ' and ', said[-1]) END AS held
        FROM (SELECT *, list_filter([
            CASE WHEN collaborator_count > 0 THEN concat(format('{:,}', collaborator_count), ' collaborator',
                 CASE WHEN collaborator_count = 1 THEN '' ELSE 's' END) END,
            CASE WHEN label_count > 0 THEN concat(format('{:,}', label_count), ' label',
                 CASE WHEN label_count = 1 THEN '' ELSE 's' END) END,
            CASE WHEN release_count > 0 THEN concat(format('{:,}', release_count), ' release',
                 CASE WHEN release_count = 1 THEN '' ELSE 's' END) END], lambda x: x IS NOT NULL) AS said
          FROM k_coverage)""",
)
def share_span_count(b):
    part = lambda column, noun: F.struct(F.col(column).alias("n"), F.lit(noun).alias("noun"))
    parts = F.array(
        part("collaborator_count", "collaborator"), part("label_count", "label"), part("release_count", "release")
    )
    return b.derived["artist_coverage"].select(
        "artist_id",
        P.share_percent(F.col("seed_share")).alias("share"),
        P.year_span(F.col("first_year"), F.col("last_year")).alias("years"),
        P.count_line(parts).alias("held"),
    )


# --- text -------------------------------------------------------------------------------


@query(
    "t1_split_credit",
    r"""SELECT release_id, artist_id, position, array_to_string(list_filter(list_transform(
        string_split(regexp_replace(role, '\s*\[[^\]]*\]', '', 'g'), ','), lambda p: trim(p)),
        lambda p: p <> ''), chr(10)) AS parts
        FROM (SELECT release_id, artist_id, CAST(position AS BIGINT) AS position, role FROM k_cred)""",
)
def split_credit(b):
    return b.cat.credits.select(
        "release_id", "artist_id", "position", T.split_credit(F.col("role")).alias("parts")
    )


@query(
    "t2_role_key",
    r"""SELECT role, trim(regexp_replace(regexp_replace(lower(role), '[-_/]+', ' ', 'g'), '\s+', ' ', 'g'))
        AS role_key, count(*) AS n FROM k_cred GROUP BY 1""",
)
def role_key(b):
    return b.cat.credits.groupBy("role", T.role_key(F.col("role")).alias("role_key")).agg(F.count("*").alias("n"))


# The names the vocabulary gives the roles of this binding, in its reading order.
SUMMARY = """CASE role WHEN 'Photography By, Design' THEN 'Design|Photography'
        WHEN 'Producer [Produced By]' THEN 'Production'
        WHEN 'Engineer [Sigma Sound, New York], Mixed By' THEN 'Engineering|Mixing' ELSE 'Writing' END"""
READING_ORDER = ("Production", "Writing", "Engineering", "Mixing", "Design", "Photography")
SUMMARISED = f"""SELECT c.artist_id, c.collaborator_id, list_filter({list(READING_ORDER)},
        lambda x: coalesce(list_contains(names, x), false)) AS names FROM k_collab c LEFT JOIN (
        SELECT aid AS artist_id, bid AS collaborator_id, list(DISTINCT name) AS names FROM (
        SELECT aid, bid, unnest(string_split({SUMMARY}, '|')) AS name FROM (
        SELECT aid, bid, unnest(string_split(roles, chr(10))) AS role FROM k_pair_roles)) GROUP BY 1, 2) s
        ON s.artist_id = c.artist_id AND s.collaborator_id = c.collaborator_id"""


def _held(b):
    """Every pair; one without roles has nothing to say."""
    return b.derived["artist_collaborators"].select("artist_id", "collaborator_id", "roles")


@query(
    "t3_summarise_roles",
    "SELECT artist_id, collaborator_id, array_to_string(names, chr(10)) AS names FROM k_summary",
    {"k_summary": SUMMARISED},
)
def summarise_roles(b):
    return _held(b).select("artist_id", "collaborator_id", T.summarise_roles(F.col("roles")).alias("names"))


@query(
    "t4_credit_line",
    "SELECT artist_id, collaborator_id, array_to_string(names, ' · ') AS line FROM k_summary",
    {"k_summary": SUMMARISED},
)
def credit_line(b):
    return _held(b).select("artist_id", "collaborator_id", T.credit_line(F.col("roles")).alias("line"))


# Role texts of many forms: known names said several ways, names the vocabulary lacks, brackets
# that hold commas, nest, cross or never close, and repeats; over 700 distinct ones.
FORMS = (
    ("Producer", "Producer", "Production", 1),
    ("Co-Producer", "Co-Producer", "Production", 1),
    ("written  by", "written by", "Writing", 2),
    ("Mixed_By", "Mixed_By", "Mixing", 3),
    ("LEAD GUITAR", "LEAD GUITAR", "Guitar", 4),
    (" Photography By ", "Photography By", "Photography", 5),
    ("Kazoo", "Kazoo", "Kazoo", 9),
    ("Thumb\tPiano", "Thumb Piano", "Thumb Piano", 9),
)
BRACKETS = ("", " [Room A, Berlin]", " [Two (deep, er) end]", " (round, too)", " [never closed", " [a (b] c) d")
UNCLOSED = 4


def _pick(values, at: str) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + f"][{at} + 1]"


def _parts_sql(field: int) -> str:
    """What the texts of both credits say, part by part: an unclosed bracket swallows what follows."""
    said = [f[field] for f in FORMS]
    first, second = _pick(said, "k1"), _pick(said, "k3")
    again = _pick(said, "(k1 + k3) % 8")
    return f"""list_concat(
        CASE WHEN k2 = {UNCLOSED} THEN [{first}] WHEN again THEN [{first}, {second}, {first}] ELSE [{first}, {second}] END,
        [{again}])"""


ROLE_TEXTS = f"""SELECT *, concat({_pick([f[0] for f in FORMS], 'k1')}, {_pick(BRACKETS, 'k2')}, ', ', {_pick([f[0] for f in FORMS], 'k3')},
        CASE WHEN again THEN concat(',', {_pick([f[0] for f in FORMS], 'k1')}) ELSE '' END) AS role
    FROM (SELECT l_orderkey, l_linenumber, l_partkey % 8 AS k1, l_suppkey % 6 AS k2, (l_orderkey + l_linenumber) % 8 AS k3,
        l_orderkey % 3 = 0 AS again FROM lineitem)"""


def _role_texts(b):
    form = lambda at: F.get(F.lit([f[0] for f in FORMS]), at.cast("int"))
    k1, k2, k3 = F.col("l_partkey") % 8, F.col("l_suppkey") % 6, (F.col("l_orderkey") + F.col("l_linenumber")) % 8
    again = F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit(","), form(k1))).otherwise("")
    role = F.concat(form(k1), F.get(F.lit(list(BRACKETS)), k2.cast("int")), F.lit(", "), form(k3), again)
    rows = B.read(b.spark, b.sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", role.alias("role"), form((k1 + k3) % 8).alias("other"))


@query(
    "t1_bracketed_credits",
    f"""SELECT role, array_to_string(list_slice(parts, 1, len(parts) - 1), chr(10)) AS parts, count(*) AS n
        FROM (SELECT role, {_parts_sql(1)} AS parts FROM k_role_texts) GROUP BY ALL""",
    {"k_role_texts": ROLE_TEXTS},
)
def bracketed_credits(b):
    rows = _role_texts(b).groupBy("role").agg(F.count("*").alias("n"))
    return rows.select("role", T.split_credit(F.col("role")).alias("parts"), "n")


@query(
    "t2_role_keys",
    r"""SELECT role, trim(regexp_replace(regexp_replace(lower(role), '[-_/]+', ' ', 'g'), '\s+', ' ', 'g'))
        AS role_key, count(*) AS n FROM k_role_texts GROUP BY 1""",
    {"k_role_texts": ROLE_TEXTS},
)
def role_keys(b):
    return _role_texts(b).groupBy("role", T.role_key(F.col("role")).alias("role_key")).agg(F.count("*").alias("n"))


@query(
    "t3_many_roles",
    f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, array_to_string(names, chr(10)) AS names,
        array_to_string(names, ' · ') AS line FROM (
        SELECT l_orderkey, l_linenumber, list_transform(list_sort(list_filter(
          list_transform(range(1, len(said) + 1), lambda i: {{'rank': ranks[i], 'at': i, 'name': said[i]}}),
          lambda s: list_position(said, s.name) = s.at)), lambda s: s.name) AS names
        FROM (SELECT l_orderkey, l_linenumber, {_parts_sql(2)} AS said, {_parts_sql(3)} AS ranks FROM k_role_texts))""",
    {"k_role_texts": ROLE_TEXTS},
)
def many_roles(b):
    """Two credits a row, of which the second repeats or adds a name."""
    said = F.array("role", "other")
    return _role_texts(b).select(
        "l_orderkey", "l_linenumber", T.summarise_roles(said).alias("names"), T.credit_line(said).alias("line")
    )


BIOS = """SELECT concat('a', id) AS id, profile FROM k_adump_all UNION ALL
    SELECT concat('l', id), profile FROM k_ldump_all"""


def _bios(b):
    tag = lambda df, kind: df.select(F.concat(F.lit(kind), F.col("id")).alias("id"), "profile")
    return tag(b.whole_artists_dump, "a").unionByName(tag(b.whole_labels_dump, "l"))


@query(
    "t5_profile_references",
    r"""SELECT DISTINCT t.id AS entity_id, t.kind, t.ref_id, coalesce(a.name, l.name) AS name FROM (
          SELECT id, lower(token[2]) AS kind, CAST(token[3:-2] AS BIGINT) AS ref_id FROM (
            SELECT id, unnest(regexp_extract_all(profile, '\[[aAlL][0-9]+\]')) AS token FROM k_bios)) t
        LEFT JOIN k_artists a ON t.kind = 'a' AND a.id = t.ref_id
        LEFT JOIN k_labels l ON t.kind = 'l' AND l.id = t.ref_id""",
    {"k_bios": BIOS},
)
def profile_references(b):
    return V.profile_references(_bios(b), b.entities["artists"], b.entities["labels"])


def _rendered(table: str, kind: str, key: str, name: str, label: str, own: str) -> str:
    return f"""SELECT concat('{own}', {key}) AS entity_id, concat('From ', {kind}, ' with ',
        coalesce(a.name, concat('artist ', {key} + 7)), ' and ',
        coalesce(l.name, concat('label ', {key} % 120)), ',', chr(10), 'as ', {name},
        ' on its site, not javascript:1 ever.') AS text, CAST(3 AS BIGINT) AS n_links
        FROM {table} d LEFT JOIN k_artists a ON a.id = {key} + 7 LEFT JOIN k_labels l ON l.id = {key} % 120"""


@query(
    "t6_render_profile",
    _rendered("part", "p_type", "p_partkey", "p_name", "", "a")
    + " UNION ALL "
    + _rendered("supplier", "s_nationkey", "s_suppkey", "s_name", "", "l"),
)
def render_profile(b):
    rendered = V.render_profile(_bios(b), b.entities["artists"], b.entities["labels"])
    return rendered.select("entity_id", "text", F.size("links").alias("n_links"))


@query(
    "t7_outbound_links",
    r"""SELECT entity_id, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY pos) - 1 AS BIGINT) AS pos, name, url
        FROM (SELECT entity_id, min(pos) AS pos, name, arg_min(url, pos) AS url FROM (
          SELECT page_id AS entity_id, pos, url, CASE WHEN host LIKE '%wikipedia.org' THEN 'Wikipedia'
                 WHEN host LIKE '%x.com' THEN 'X' ELSE host END AS name FROM (
            SELECT page_id, u.pos, u.url,
                   regexp_replace(regexp_extract(u.url, '^https?://([^/?#:]+)', 1), '^www\.', '') AS host
            FROM (SELECT page_id, unnest([{'pos': 1, 'url': url},
                   {'pos': 2, 'url': replace(url, 'http://', 'https://')}, {'pos': 3, 'url': 'facebook:foo'},
                   {'pos': 4, 'url': concat('https://en.wikipedia.org/wiki/', page_id)},
                   {'pos': 5, 'url': replace(url, '.example.', '.fedex.')},
                   {'pos': 6, 'url': concat('http://p', page_id, '.example/')},
                   {'pos': 7, 'url': 'javascript:alert(1)'},
                   {'pos': 8, 'url': concat('http://q', page_id, '.example:80/a b')},
                   {'pos': 9, 'url': concat('http://r', page_id, '.example')}]) AS u FROM pages))
          WHERE host <> '') GROUP BY entity_id, name) QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY pos) <= 5""",
)
def outbound_links(b):
    page = F.col("page_id").cast("string")
    urls = F.array(
        F.col("url"),
        F.replace("url", F.lit("http://"), F.lit("https://")),
        F.lit("facebook:foo"),
        F.concat(F.lit("https://en.wikipedia.org/wiki/"), page),
        F.replace("url", F.lit(".example."), F.lit(".fedex.")),
        F.concat(F.lit("http://p"), page, F.lit(".example/")),
        F.lit("javascript:alert(1)"),
        F.concat(F.lit("http://q"), page, F.lit(".example:80/a b")),
        F.concat(F.lit("http://r"), page, F.lit(".example")),
    )
    pages = B.read(b.spark, b.sf_dir, "pages").select(F.col("page_id").alias("id"), urls.alias("urls"))
    return V.outbound_links(pages)


@query(
    "t8_split_lines",
    """SELECT doc_id, len(lines) AS n, array_to_string(lines, '|') AS lines FROM (
        SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS lines FROM documents)""",
)
def split_lines(b):
    """Over whole document texts, which repeat lines and hold blank ones."""
    docs = B.read(b.spark, b.sf_dir, "documents").select("doc_id", T.split_lines(F.col("text")).alias("lines"))
    return docs.select("doc_id", F.size("lines").alias("n"), F.array_join("lines", "|").alias("lines"))


@query(
    "t9_normalise_query",
    r"""SELECT c_custkey AS id, nullif(rtrim(concat(' ', trim(regexp_replace(strip_accents(lower(c_name)),
        '[^\p{L}\p{N}]+', ' ', 'g')))), '') AS phrase FROM customer""",
)
def normalise_query(b):
    customers = B.read(b.spark, b.sf_dir, "customer")
    return customers.select(F.col("c_custkey").alias("id"), T.normalise_query(F.col("c_name")).alias("phrase"))


@query(
    "t10_canonical_path",
    r"""SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+|[?#].*$', '', 'g'),
        '/+$', ''), ''), '/') AS path FROM pages""",
)
def canonical_path(b):
    path = F.regexp_replace("url", "^[a-z]+://[^/]+|[?#].*$", "")
    return B.read(b.spark, b.sf_dir, "pages").select("page_id", T.canonical_path(path).alias("path"))
