"""Join, aggregate, set and order forms over the tables themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from crateline.operators import relational as R
from driver_binding import catalogue as B
from driver_binding.oracle import SC, sql_list
from driver_binding.registry import query


def _orders(b):
    return B.read(b.spark, b.sf_dir, "orders")


def _items(b):
    return B.read(b.spark, b.sf_dir, "lineitem")


@query(
    "j1_inner_equi",
    "SELECT o_orderkey, o_custkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey",
)
def inner_equi(b):
    customers = B.read(b.spark, b.sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return R.inner_join(_orders(b).select("o_orderkey", "o_custkey"), customers, ["o_custkey"])


@query(
    "j2_left_outer_equi",
    """SELECT artist_id, seed_releases, total, n FROM k_corpus LEFT JOIN k_tally USING (artist_id)
        LEFT JOIN k_totals USING (artist_id)
        LEFT JOIN (SELECT artist_id, count(*) AS n FROM k_pairs GROUP BY 1) USING (artist_id)""",
)
def left_outer_equi(b):
    on_labels = b.seed.pairs.groupBy("artist_id").agg(F.count("*").alias("n"))
    members = b.corpus["corpus_artists"].select("artist_id")
    return R.left_join_all(members, [b.seed.tally, b.seed.totals, on_labels], "artist_id")


@query(
    "j3_people_who_share",
    """SELECT a.l_partkey AS a, b.l_partkey AS b, a.l_orderkey AS l_orderkey
        FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) a
        JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) b
          ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey
        WHERE a.l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) <= 6)""",
)
def people_who_share(b):
    return R.people_who_share(_items(b), "l_orderkey", "l_partkey", b.dials.max_people_per_release)


@query(
    "j4_left_semi",
    "SELECT release_id, artist_id, role FROM k_cred WHERE artist_id IN (SELECT artist_id FROM k_seed_art)",
)
def left_semi(b):
    return R.semi_join(b.cat.credits.select("release_id", "artist_id", "role"), b.seed.artists, "artist_id")


@query(
    "j5_exists",
    """SELECT release_id, style FROM k_sty s
        WHERE EXISTS (SELECT 1 FROM k_gen g WHERE g.release_id = s.release_id AND g.genre = '2-HIGH')""",
)
def exists(b):
    return R.with_match(b.cat.styles, b.cat.genres.filter("genre = '2-HIGH'"), "release_id")


@query(
    "j6_left_anti",
    """SELECT p_partkey AS artist_id, p_name FROM part
        WHERE NOT EXISTS (SELECT 1 FROM k_seed_art s WHERE s.artist_id = p_partkey)""",
)
def left_anti(b):
    parts = B.read(b.spark, b.sf_dir, "part").select(F.col("p_partkey").alias("artist_id"), "p_name")
    return R.anti_join(parts, b.seed.artists, "artist_id")


@query(
    "j7_in_id_list",
    f"""SELECT l_orderkey, l_partkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem
        WHERE l_partkey IN {sql_list(SC.core_artists)}""",
)
def in_id_list(b):
    rows = _items(b).select("l_orderkey", "l_partkey", "l_linenumber")
    return R.in_id_list(rows, b.dials.scene.core_artists, "l_partkey")


@query(
    "j8_scalar_aggregates",
    """SELECT s_suppkey, s_name, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_suppkey = s_suppkey) AS orders,
        (SELECT min(year(l_shipdate)) FROM lineitem WHERE l_suppkey = s_suppkey) AS first_year,
        (SELECT max(year(l_shipdate)) FROM lineitem WHERE l_suppkey = s_suppkey) AS last_year FROM supplier""",
)
def scalar_aggregates(b):
    suppliers = B.read(b.spark, b.sf_dir, "supplier").select("s_suppkey", "s_name")
    rows = _items(b).select(
        F.col("l_suppkey").alias("s_suppkey"), "l_orderkey", F.year("l_shipdate").alias("year")
    )
    return R.with_scalar_aggregates(
        suppliers,
        rows,
        "s_suppkey",
        orders=F.countDistinct("l_orderkey"),
        first_year=F.min("year"),
        last_year=F.max("year"),
    )


@query("j9_both_directions", "SELECT id, other_id, kind FROM k_near")
def both_directions(b):
    return R.both_directions(b.entities["artist_relations"])


@query(
    "j10_per_threshold",
    """SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER (WHERE l_discount >= t) AS items
        FROM lineitem, (SELECT unnest([0.02, 0.05, 0.1, 0.25]) AS t) GROUP BY 1""",
)
def per_threshold(b):
    return R.per_threshold(
        _items(b).select("l_discount"), (0.02, 0.05, 0.1, 0.25),
        lambda t: F.count_if(F.col("l_discount") >= t), "items",
    )


# --- aggregates -------------------------------------------------------------------------


@query(
    "a1_count_non_null",
    "SELECT release_id, count(*) AS refs, count(label_id) AS n FROM k_lab GROUP BY 1",
)
def count_non_null(b):
    refs = R.count_rows(b.cat.label_refs, ["release_id"]).withColumnRenamed("n", "refs")
    return refs.join(R.count_rows(b.cat.label_refs, ["release_id"], "label_id"), "release_id")


@query("a2_count_distinct", "SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1")
def count_distinct(b):
    return R.count_distinct(_items(b), ["l_suppkey"], "l_partkey")


@query(
    "a3_count_distinct_if",
    """SELECT l_partkey, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END) AS n
        FROM lineitem GROUP BY 1""",
)
def count_distinct_if(b):
    return R.count_distinct_if(_items(b), ["l_partkey"], "l_orderkey", F.col("l_returnflag") == "R")


@query(
    "a4_conditional_sum",
    "SELECT user_id, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS n FROM events GROUP BY 1",
)
def conditional_sum(b):
    events = B.read(b.spark, b.sf_dir, "events")
    return R.count_if(events, ["user_id"], F.col("event_type") == "click")


@query(
    "a5_min_max_span",
    """SELECT label_id, min(year) AS first_year, max(year) AS last_year
        FROM k_lab JOIN k_rel ON id = release_id GROUP BY 1""",
)
def min_max_span(b):
    years = b.cat.releases.select(F.col("id").alias("release_id"), "year")
    return R.span(b.cat.label_refs.join(years, "release_id"), ["label_id"], "year")


@query(
    "a6_joined_text",
    "SELECT artist_id, string_agg(DISTINCT role, chr(10) ORDER BY role) AS role FROM k_cred GROUP BY 1",
)
def joined_text(b):
    return R.joined_text(b.cat.credits, ["artist_id"], "role", "\n")


@query(
    "a7_arg_min",
    """SELECT release_id, catno FROM (SELECT release_id, catno, row_number() OVER (PARTITION BY release_id
        ORDER BY position, catno NULLS FIRST) AS rn FROM k_lab) WHERE rn = 1""",
)
def arg_min(b):
    return R.arg_min(b.cat.label_refs, ["release_id"], "catno", ["position"])


@query(
    "a8_having",
    """SELECT l_suppkey, count(*) AS items, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1
        HAVING count(*) >= 5 AND count(DISTINCT l_partkey) / count(*) >= 0.865""",
)
def having(b):
    aggs = [F.count("*").alias("items"), F.countDistinct("l_partkey").alias("parts")]
    enough = (F.col("items") >= 5) & (F.col("parts") / F.col("items") >= 0.865)
    return R.having(_items(b), ["l_suppkey"], aggs, enough)


# --- sets and order -----------------------------------------------------------------------


def _sides(b):
    pick = lambda df: df.select("release_id", "artist_id")
    return pick(b.cat.line), pick(b.cat.credits)


@query(
    "x1_union_all",
    "SELECT release_id, artist_id FROM k_line UNION ALL SELECT release_id, artist_id FROM k_cred",
)
def union_all(b):
    return R.union_all(*_sides(b))


@query(
    "x2_union_distinct",
    "SELECT release_id, artist_id FROM k_line UNION SELECT release_id, artist_id FROM k_cred",
)
def union_distinct(b):
    return R.union_distinct(*_sides(b))


@query("x3_distinct", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def distinct(b):
    return R.distinct(_items(b), ["l_suppkey", "l_returnflag"])


@query(
    "l1_order_nulls_last",
    """SELECT id, title, year, row_number() OVER (ORDER BY year DESC NULLS LAST, title, id) AS place
        FROM k_rel""",
)
def order_nulls_last(b):
    """The whole newest-first order, numbered as it comes."""
    ordered = R.newest_first(b.cat.releases, "year", "title", "id")
    return R.numbered(b.stage.table("newest_first", lambda: R.placed(ordered)), "place")


@query("l2_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_k(b):
    order = [F.col("o_totalprice").desc(), F.col("o_orderkey")]
    return R.top_k(_orders(b).select("o_orderkey", "o_totalprice"), order, 100)


@query(
    "l3_top_k_per_group",
    """SELECT o_custkey, o_orderkey, o_totalprice, place FROM (SELECT *, row_number() OVER (
        PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3""",
)
def top_k_per_group(b):
    rows = _orders(b).select("o_custkey", "o_orderkey", "o_totalprice")
    order = [F.col("o_totalprice").desc(), F.col("o_orderkey")]
    return R.top_k_per_group(rows, ["o_custkey"], order, 3, rank="place")


@query(
    "l4_banded_order",
    """SELECT o_orderkey, o_orderpriority, o_totalprice, row_number() OVER (ORDER BY
        CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END,
        o_totalprice DESC, o_orderpriority, o_orderkey) AS place
        FROM orders""",
)
def banded_order(b):
    band = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    rows = _orders(b).select("o_orderkey", "o_orderpriority", "o_totalprice")
    ordered = R.banded_order(rows, band, "o_totalprice", "o_orderpriority", "o_orderkey")
    return R.numbered(b.stage.table("banded_order", lambda: R.placed(ordered)), "place")
