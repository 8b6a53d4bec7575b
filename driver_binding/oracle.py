"""The catalogue and every table derived from it, as named SQL subqueries for DuckDB.

``state(sql)`` puts the subqueries a statement names in front of it.
"""

from __future__ import annotations

import re

from driver_binding.catalogue import DIALS


def sql_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + ")"


def any_style(values) -> str:
    return f"coalesce(bool_or(style IN {sql_list(values)}), false)"


def marker(column: str, markers) -> str:
    tests = " OR ".join(f"contains(lower({column}), '{m}')" for m in markers)
    return f"coalesce({tests}, false)"


D, S, G, SC = DIALS, DIALS.seed, DIALS.grades, DIALS.scene
RULES = list(enumerate(D.traditions))
REAL_PERSON = (
    f"NOT (artist_id <= 0 OR artist_id IN {sql_list(D.placeholder_ids)} "
    f"OR trim(name) IN {sql_list(D.placeholder_names)})"
)
PLACEHOLDER_LABEL = f"starts_with(lower(ltrim(name)), '{D.placeholder_label_prefix}')"
GRADE_RANK = "CASE {0} WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END"
BAND_RANK = "CASE {0} WHEN 'core' THEN 0 WHEN 'named' THEN 1 ELSE 2 END"


def grade_artist(seeds: str, share: str) -> str:
    return f"""CASE WHEN {seeds} IS NULL OR {seeds} < 1 THEN 'none'
        WHEN {seeds} >= {G.high_min_releases} AND {share} >= {G.high_min_share} THEN 'high'
        WHEN {seeds} >= {G.medium_or_releases} THEN 'medium'
        WHEN {seeds} >= {G.medium_min_releases} AND {share} >= {G.medium_min_share} THEN 'medium'
        ELSE 'low' END"""


def grade_label(seeds: str, total: str) -> str:
    ratio = f"{seeds} / nullif({total}, 0)"
    return f"""CASE WHEN coalesce({seeds}, 0) = 0 THEN 'none'
        WHEN {seeds} >= {G.label_high_min_artists} AND {ratio} >= {G.label_high_min_ratio} THEN 'high'
        WHEN {seeds} >= {G.label_medium_min_artists} AND {ratio} >= {G.label_medium_min_ratio}
        THEN 'medium' ELSE 'low' END"""


def profile(key: str, name: str, kind: str) -> str:
    return (
        f"concat('[b]From[/b] ', {kind}, ' with [a', {key} + 7, '] and [L', {key} % 120, "
        f"'],', chr(10), 'as [a=', {name}, '] on [url=http://x.example/', {key}, "
        f"']its site[/url], not [url=javascript:1][/url] [i]ever[/i].')"
    )


def rule_matches() -> str:
    parts = []
    for i, rule in RULES:
        if rule.styles and rule.genre:
            parts.append(
                f"SELECT release_id, {i} AS rule FROM k_c_sty WHERE style IN {sql_list(rule.styles)} "
                f"AND release_id IN (SELECT release_id FROM k_c_gen WHERE genre = '{rule.genre}')"
            )
        elif rule.styles:
            parts.append(
                f"SELECT release_id, {i} AS rule FROM k_c_sty WHERE style IN {sql_list(rule.styles)}"
            )
        elif rule.genre:
            parts.append(f"SELECT release_id, {i} AS rule FROM k_c_gen WHERE genre = '{rule.genre}'")
        else:
            parts.append(
                f"SELECT release_id, {i} AS rule FROM k_c_lab WHERE label_id IN {sql_list(rule.labels)}"
            )
    return " UNION ".join(parts)


RULE_TABLE = "(VALUES " + ", ".join(
    f"({i}, '{r.name}', '{r.floor}', {r.min_releases}, {r.min_share})" for i, r in RULES
) + ") AS r(rule, rule_name, floor, min_releases, min_share)"

def seed_rule(rule) -> dict[str, str]:
    return {
        "k_tag_facts": f"""SELECT release_id, {any_style(rule.disqualifying)} AS disq,
        {any_style(rule.core)} AS core, {any_style(rule.broad)} AS broad,
        {any_style(rule.needs_companion)} AS needs, {any_style(rule.companions)} AS comp
        FROM k_sty GROUP BY release_id""",
        "k_seed_rel": f"""SELECT r.* FROM k_rel r JOIN k_tag_facts f ON f.release_id = r.id
        JOIN k_gen g ON g.release_id = r.id
        WHERE NOT disq AND (core OR (g.genre IN {sql_list(rule.gate_genres)} AND (broad OR (needs AND comp))))""",
    }


def hop(dials) -> dict[str, str]:
    return {
        "k_bridges": f"""SELECT artist_id FROM k_seed_art LEFT JOIN k_totals USING (artist_id)
        WHERE total IS NULL OR seed_releases / greatest(1, total) >= {dials.bridge_min_ratio}""",
        "k_crowd": f"""SELECT release_id, count(*) > {dials.max_people_to_admit} AS crowded
        FROM k_admiss GROUP BY release_id""",
        "k_corpus": f"""SELECT * FROM (
        SELECT coalesce(s.artist_id, t.artist_id) AS artist_id, s.artist_id IS NOT NULL AS is_seed,
               coalesce(ties_a, 0) > 0 AND (s.artist_id IS NOT NULL OR ties_a >= {dials.min_ties}) AS channel_a,
               coalesce(via_b, false) AS channel_b
        FROM k_seed_art s FULL JOIN k_ties t ON t.artist_id = s.artist_id)
        WHERE is_seed OR channel_a OR channel_b""",
    }


K = {
    # --- the catalogue ---
    "k_rel": """SELECT o_orderkey AS id, concat('Order ', o_orderkey) AS title,
        CASE WHEN NOT (o_orderpriority = '5-LOW' AND o_orderstatus = 'P') THEN year(o_orderdate) END AS year
        FROM orders""",
    "k_item": """SELECT l_orderkey AS release_id, l_linenumber - 1 AS position, l_partkey AS artist_id,
        p_name AS name, l_linestatus, l_returnflag FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "k_line": """SELECT release_id, position, artist_id, name,
        CASE l_returnflag WHEN 'A' THEN '&' WHEN 'R' THEN ',' END AS join_phrase
        FROM k_item WHERE l_linestatus = 'F'""",
    "k_cred": """SELECT release_id, position, artist_id, name,
        CASE WHEN position = 6 THEN 'Photography By, Design'
             WHEN l_returnflag = 'A' THEN 'Producer [Produced By]'
             WHEN l_returnflag = 'R' THEN 'Engineer [Sigma Sound, New York], Mixed By'
             ELSE 'Written-By' END AS role
        FROM k_item WHERE l_linestatus = 'O'""",
    "k_lab": """SELECT l_orderkey AS release_id, l_linenumber - 1 AS position,
        CASE WHEN l_tax <= 0.075 THEN l_suppkey END AS label_id,
        CASE WHEN l_suppkey % 17 = 0 THEN 'Not On label (x)' ELSE s_name END AS name,
        CASE WHEN l_discount > 0.005 THEN concat('CAT ', CAST(l_quantity AS INT)) END AS catno
        FROM lineitem JOIN supplier ON s_suppkey = l_suppkey""",
    "k_sty": """SELECT DISTINCT l_orderkey AS release_id, p_brand AS style
        FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "k_gen": "SELECT o_orderkey AS release_id, o_orderpriority AS genre FROM orders",
    "k_app": """SELECT release_id, artist_id, name, NULL AS role FROM k_line
        UNION ALL SELECT release_id, artist_id, name, role FROM k_cred""",
    "k_person": f"SELECT * FROM k_app WHERE {REAL_PERSON}",
    "k_usable": f"SELECT * FROM k_lab WHERE label_id IS NOT NULL AND NOT {PLACEHOLDER_LABEL}",
    # --- seed ---
    "k_pairs": f"""SELECT DISTINCT label_id, artist_id FROM k_usable
        JOIN (SELECT release_id, artist_id FROM k_line WHERE {REAL_PERSON}) USING (release_id)""",
    **seed_rule(S),
    "k_seed_app": "SELECT * FROM k_app WHERE release_id IN (SELECT id FROM k_seed_rel)",
    "k_tally": f"""SELECT artist_id, count(*) AS seed_releases FROM k_seed_app
        WHERE {REAL_PERSON} AND NOT {marker('role', D.packaging_roles)} GROUP BY artist_id""",
    "k_totals": """SELECT artist_id, count(*) AS total FROM k_app
        WHERE artist_id IN (SELECT artist_id FROM k_tally) GROUP BY artist_id""",
    "k_seed_art": f"""SELECT artist_id, seed_releases, total AS total_releases
        FROM k_tally LEFT JOIN k_totals USING (artist_id)
        WHERE seed_releases / greatest(1, coalesce(total, seed_releases)) >= {D.min_seed_ratio}""",
    "k_label_counts": """SELECT label_id, count(s.artist_id) AS seeds, count(*) AS total
        FROM k_pairs p LEFT JOIN k_seed_art s USING (artist_id) GROUP BY label_id""",
    "k_seed_lab": f"""SELECT label_id, seeds AS seed_artist_count, total AS total_artist_count,
        seeds / total AS seed_ratio FROM k_label_counts
        WHERE seeds >= {D.label_min_artists} AND seeds / total >= {D.label_min_ratio}""",
    # --- one hop ---
    **hop(D),
    "k_flags": """SELECT release_id, bool_or(a) AS channel_a, bool_or(b) AS channel_b FROM (
        SELECT release_id, true AS a, false AS b FROM k_person
         WHERE artist_id IN (SELECT artist_id FROM k_bridges)
        UNION ALL SELECT release_id, false, true FROM k_usable
         WHERE label_id IN (SELECT label_id FROM k_seed_lab)) GROUP BY release_id""",
    "k_kept": """SELECT r.id, r.title, r.year, s.id IS NOT NULL AS is_seed,
        coalesce(f.channel_a, false) AS channel_a, coalesce(f.channel_b, false) AS channel_b
        FROM k_rel r LEFT JOIN k_seed_rel s ON s.id = r.id LEFT JOIN k_flags f ON f.release_id = r.id
        WHERE s.id IS NOT NULL OR f.release_id IS NOT NULL""",
    "k_admiss": f"SELECT * FROM k_person WHERE NOT {marker('role', D.authorship_roles)}",
    "k_ties": """SELECT artist_id,
        count(*) FILTER (WHERE channel_a AND NOT coalesce(crowded, false)) AS ties_a,
        bool_or(channel_b) AS via_b
        FROM k_admiss JOIN k_flags USING (release_id) LEFT JOIN k_crowd USING (release_id)
        GROUP BY artist_id""",
    "k_c_line": "SELECT * FROM k_line WHERE release_id IN (SELECT id FROM k_kept)",
    "k_c_cred": "SELECT * FROM k_cred WHERE release_id IN (SELECT id FROM k_kept)",
    "k_c_lab": "SELECT * FROM k_usable WHERE release_id IN (SELECT id FROM k_kept)",
    "k_c_sty": "SELECT * FROM k_sty WHERE release_id IN (SELECT id FROM k_kept)",
    "k_c_gen": "SELECT * FROM k_gen WHERE release_id IN (SELECT id FROM k_kept)",
    # --- entities ---
    "k_adump_all": f"""SELECT p_partkey AS id, p_name AS name,
        CASE WHEN p_type <> 'PROMO' THEN p_type END AS real_name,
        {profile('p_partkey', 'p_name', 'p_type')} AS profile,
        list_slice([concat('https://www.facebook.com/', p_partkey),
                    concat('http://shop.example/', p_brand), 'facebook:foo'], 1, p_size % 4) AS urls,
        list_slice([{{'kind': 'alias', 'id': p_partkey + 7, 'name': concat('Alias ', p_partkey + 7)}},
                    {{'kind': 'member', 'id': p_partkey + 11, 'name': 'Member'}},
                    {{'kind': 'group', 'id': p_partkey * 3 + 1, 'name': ''}}],
                   CASE WHEN p_size <= 15 THEN 1 WHEN p_size <= 30 THEN 2 ELSE 1 END,
                   CASE WHEN p_size <= 15 THEN 1 ELSE 3 END) AS relations
        FROM part""",
    "k_adump": """SELECT * FROM k_adump_all
        WHERE id IN (SELECT p_partkey FROM part WHERE p_size <= 45 AND p_partkey > 0)""",
    "k_ldump_all": f"""SELECT s_suppkey AS id, s_name AS name,
        {profile('s_suppkey', 's_name', 's_nationkey')} AS profile,
        [concat('http://label.example/', s_suppkey)] AS urls
        FROM supplier""",
    "k_ldump": """SELECT * FROM k_ldump_all
        WHERE id IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 20 AND s_suppkey > 0)""",
    "k_artists": """SELECT id, name, real_name, profile, urls FROM k_adump
         WHERE id IN (SELECT artist_id FROM k_corpus)
        UNION ALL SELECT artist_id, min(name), NULL, NULL, NULL FROM (
          SELECT artist_id, name FROM k_c_line UNION ALL SELECT artist_id, name FROM k_c_cred)
         WHERE artist_id IN (SELECT artist_id FROM k_corpus)
           AND artist_id NOT IN (SELECT id FROM k_adump) GROUP BY artist_id""",
    "k_labels": """SELECT id, name, profile, urls FROM k_ldump
         WHERE id IN (SELECT label_id FROM k_c_lab)
        UNION ALL SELECT label_id, min(name), NULL, NULL FROM k_c_lab
         WHERE label_id NOT IN (SELECT id FROM k_ldump) GROUP BY label_id""",
    "k_relations": """SELECT artist_id, r.id AS related_id, r.kind AS kind, arg_min(r.name, nth) AS related_name
        FROM (SELECT id AS artist_id, unnest(relations) AS r, generate_subscripts(relations, 1) AS nth
              FROM k_adump WHERE id IN (SELECT artist_id FROM k_corpus))
        GROUP BY ALL""",
    "k_asearch": r"""SELECT id, name, concat(' ', trim(regexp_replace(
        strip_accents(lower(name)), '[^\p{L}\p{N}]+', ' ', 'g'))) AS norm FROM k_artists""",
    "k_lsearch": r"""SELECT id, name, concat(' ', trim(regexp_replace(
        strip_accents(lower(name)), '[^\p{L}\p{N}]+', ' ', 'g'))) AS norm FROM k_labels""",
    # --- derived ---
    "k_people": """SELECT release_id, artist_id, NULL AS role FROM k_c_line
         WHERE artist_id IN (SELECT artist_id FROM k_corpus)
        UNION ALL SELECT release_id, artist_id, role FROM k_c_cred
         WHERE artist_id IN (SELECT artist_id FROM k_corpus)""",
    "k_once": "SELECT DISTINCT release_id, artist_id FROM k_people",
    "k_pairable": f"""SELECT release_id FROM k_people GROUP BY release_id
        HAVING count(DISTINCT artist_id) <= {D.max_people_per_release}""",
    "k_pair_counts": """SELECT a.artist_id AS aid, b.artist_id AS bid, count(DISTINCT a.release_id) AS n
        FROM k_people a JOIN k_pairable p ON p.release_id = a.release_id
        JOIN k_people b ON b.release_id = a.release_id AND b.artist_id <> a.artist_id GROUP BY 1, 2""",
    "k_pair_roles": """SELECT aid, bid, string_agg(role, chr(10) ORDER BY role) AS roles FROM (
        SELECT DISTINCT a.artist_id AS aid, b.artist_id AS bid, b.role
        FROM k_people a JOIN k_pairable p ON p.release_id = a.release_id
        JOIN k_people b ON b.release_id = a.release_id AND b.artist_id <> a.artist_id
        WHERE b.role IS NOT NULL) GROUP BY aid, bid""",
    "k_collab": """SELECT c.aid AS artist_id, c.bid AS collaborator_id, c.n AS shared_releases, r.roles
        FROM k_pair_counts c LEFT JOIN k_pair_roles r ON r.aid = c.aid AND r.bid = c.bid""",
    "k_alabels": """SELECT p.artist_id, l.label_id, count(DISTINCT p.release_id) AS release_count,
        min(r.year) AS first_year, max(r.year) AS last_year
        FROM k_people p JOIN k_c_lab l ON l.release_id = p.release_id
        JOIN k_kept r ON r.id = p.release_id GROUP BY 1, 2""",
    "k_cov": """SELECT p.artist_id, count(DISTINCT p.release_id) AS release_count,
        count(DISTINCT CASE WHEN c.release_id IS NOT NULL THEN p.release_id END) AS credited_releases,
        count(DISTINCT CASE WHEN r.is_seed THEN p.release_id END) AS seed_n,
        min(r.year) AS first_year, max(r.year) AS last_year
        FROM k_people p JOIN k_kept r ON r.id = p.release_id
        LEFT JOIN (SELECT DISTINCT release_id FROM k_c_cred) c ON c.release_id = p.release_id
        GROUP BY 1""",
    "k_matches": rule_matches(),
    "k_lin_cand": f"""SELECT artist_id, r.rule, r.rule_name, m.n FROM (
          SELECT artist_id, rule, count(DISTINCT release_id) AS n
          FROM k_people JOIN k_matches USING (release_id) GROUP BY 1, 2) m
        JOIN k_cov USING (artist_id) JOIN {RULE_TABLE} ON r.rule = m.rule
        WHERE n >= min_releases AND n / release_count >= min_share""",
    "k_lin_tag": "SELECT artist_id, arg_min(rule_name, rule) AS lineage FROM k_lin_cand GROUP BY 1",
    "k_measured": f"""SELECT c.artist_id, coalesce(v.release_count, 0) AS release_count,
        coalesce(v.credited_releases, 0) AS credited_releases,
        coalesce(k.n, 0) AS collaborator_count, coalesce(l.n, 0) AS label_count,
        v.first_year, v.last_year, coalesce(v.seed_n, 0) AS seed_releases,
        coalesce(v.seed_n, 0) / nullif(coalesce(s.total_releases, t.total), 0) AS seed_share,
        {grade_artist('s.seed_releases', 's.seed_releases / nullif(s.total_releases, 0)')} AS scene_relevance,
        g.lineage
        FROM k_corpus c LEFT JOIN k_cov v USING (artist_id)
        LEFT JOIN (SELECT artist_id, count(*) AS n FROM k_collab GROUP BY 1) k USING (artist_id)
        LEFT JOIN (SELECT artist_id, count(*) AS n FROM k_alabels GROUP BY 1) l USING (artist_id)
        LEFT JOIN k_lin_tag g USING (artist_id) LEFT JOIN k_seed_art s USING (artist_id)
        LEFT JOIN k_totals t USING (artist_id)""",
    "k_coverage": f"""SELECT m.*, CASE
        WHEN r.floor = 'medium' AND scene_relevance IN ('none', 'low') THEN 'medium'
        WHEN r.floor = 'low' AND scene_relevance = 'none' THEN 'low'
        ELSE scene_relevance END AS relevance
        FROM k_measured m LEFT JOIN {RULE_TABLE} ON r.rule_name = m.lineage""",
    "k_lcov": f"""SELECT l.id AS label_id, coalesce(p.total, 0) AS line_artist_count,
        coalesce(p.seeds, 0) AS seed_artist_count, p.seeds / nullif(p.total, 0) AS seed_ratio,
        {grade_label('p.seeds', 'p.total')} AS relevance
        FROM k_labels l LEFT JOIN k_label_counts p ON p.label_id = l.id""",
    # --- curated lists ---
    "k_near": """SELECT artist_id AS id, related_id AS other_id, kind FROM k_relations
        UNION SELECT related_id, artist_id, kind FROM k_relations""",
    "k_core_alias": f"""SELECT DISTINCT other_id AS id FROM k_near WHERE kind = 'alias'
        AND id IN {sql_list(SC.core_artists)} AND other_id NOT IN {sql_list(SC.core_artists)}""",
    "k_named_alias": f"""SELECT DISTINCT other_id AS id FROM k_near WHERE kind = 'alias'
        AND id IN {sql_list(SC.named_artists)} AND other_id NOT IN {sql_list(SC.named_artists)}""",
    "k_scene": f"""SELECT release_id FROM k_c_lab WHERE label_id IN {sql_list(SC.scene_labels)}
        UNION SELECT release_id FROM k_c_line
        WHERE artist_id IN {sql_list(SC.core_artists)} OR artist_id IN {sql_list(SC.named_artists)}
           OR artist_id IN (SELECT id FROM k_core_alias) OR artist_id IN (SELECT id FROM k_named_alias)""",
    "k_standings": f"""SELECT a.id, a.name, CASE
        WHEN a.id IN {sql_list(SC.core_artists)} THEN 'core'
        WHEN a.id IN {sql_list(SC.named_artists)} THEN 'named'
        WHEN c.scene < {SC.alias_floor} THEN 'found'
        WHEN a.id IN (SELECT id FROM k_core_alias) THEN 'core'
        WHEN a.id IN (SELECT id FROM k_named_alias) THEN 'named' ELSE 'found' END AS standing,
        c.scene AS scene_releases, t.line AS line_releases
        FROM (SELECT artist_id, count(DISTINCT release_id) AS scene
              FROM k_c_line JOIN k_scene USING (release_id) GROUP BY 1) c
        JOIN k_artists a ON a.id = c.artist_id
        JOIN (SELECT artist_id, count(DISTINCT release_id) AS line FROM k_c_line GROUP BY 1) t
          ON t.artist_id = a.id
        WHERE a.id NOT IN {sql_list(SC.excluded_ids)} AND a.name NOT IN {sql_list(SC.excluded_names)}""",
    "k_top_artists": f"""SELECT s.*, scene_releases * scene_releases / line_releases AS weight
        FROM k_standings s
        ORDER BY {BAND_RANK.format('standing')}, weight DESC, name, id LIMIT 1000""",
    # --- nested records, from order rows alone ---
    "k_nested": """SELECT o_orderkey AS id, concat('Order ', o_orderkey) AS title,
        year(o_orderdate) AS year, o_custkey AS who, o_custkey + 1 + o_orderkey % 5 AS other, c_name,
        o_orderstatus AS status, o_orderpriority AS genre, c_nationkey AS nation, c_mktsegment AS segment
        FROM orders JOIN customer ON c_custkey = o_custkey""",
    "k_n_line": """SELECT id AS release_id, 0 AS position, who AS artist_id, c_name AS name,
        CASE WHEN status = 'F' THEN '&' END AS join_phrase FROM k_nested
        UNION ALL SELECT id, 1, other, concat('Person ', other), NULL FROM k_nested WHERE status = 'F'""",
    "k_n_cred": """SELECT id AS release_id, 0 AS position, who AS artist_id,
        concat('Person ', who) AS name, 'Producer' AS role FROM k_nested WHERE genre = '1-URGENT'
        UNION ALL SELECT id, 1, other + 3, concat('Person ', other + 3), 'Engineer [Dub, Mix]'
        FROM k_nested WHERE genre = '1-URGENT'
        UNION ALL SELECT id, 0, other, concat('Person ', other), 'Written-By'
        FROM k_nested WHERE genre = '2-HIGH'""",
    "k_n_lab": """SELECT id AS release_id, 0 AS position, nation AS label_id,
        CASE WHEN nation % 5 = 0 THEN 'Not On Label' ELSE concat('Nation ', nation) END AS name,
        CASE WHEN status <> 'P' THEN concat('N-', nation) END AS catno FROM k_nested
        UNION ALL SELECT id, 1, NULL, 'Unlinked', 'U' FROM k_nested
        UNION ALL SELECT id, 2, nation + 100, concat('Series ', nation), NULL FROM k_nested""",
}

def anew(tag: str, changed: dict[str, str]) -> dict[str, str]:
    """Every subquery again under names with a tag, those of ``changed`` in its words; what the
    nested records hold keeps its name."""
    own = lambda sql: re.sub(r"\bk_(?!nested\b|n_)([a-z_]+)\b", rf"k_{tag}_\1", sql)
    return {own(name): own(sql) for name, sql in {**K, **changed}.items()}


_NAME = re.compile(r"\bk_[a-z_]+\b")


def state(sql: str, extra: dict[str, str] | None = None) -> str:
    """The statement with every subquery it names, each after those it needs."""
    known = {**K, **(extra or {})}
    placed: list[str] = []

    def place(name: str) -> None:
        if name in placed or name not in known:
            return
        for needed in _NAME.findall(known[name]):
            if needed != name:
                place(needed)
        placed.append(name)

    for name in _NAME.findall(sql):
        place(name)
    if not placed:
        return sql
    body = ",\n".join(f"{name} AS MATERIALIZED ({known[name]})" for name in placed)
    return f"WITH {body}\n{sql}"
