import random

import pytest
from pyspark.sql import functions as F

from crateline.functions import predicates as P
from crateline.functions import text as T
from crateline.operators import serve as V


def one(spark, expression, **cells):
    df = spark.range(1)
    for name, value in cells.items():
        df = df.withColumn(name, value if hasattr(value, "alias") else F.lit(value))
    return df.select(expression.alias("x")).head()[0]


def strings(*values):
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


@pytest.mark.parametrize(
    "styles, genres, want",
    [
        (["Dub Techno"], [], True),
        (["House"], ["Electronic"], False),
        (["Dub"], ["Electronic"], True),
        (["Dub"], ["Reggae"], False),
        (["Ambient"], ["Electronic"], False),
        (["Ambient", "Techno"], ["Electronic"], True),
        (["Dub Techno", "Soundtrack"], ["Electronic"], False),
        ([], [], False),
    ],
)
def test_seed_rule(spark, styles, genres, want):
    assert one(spark, P.is_seed_release(F.col("s"), F.col("g")), s=strings(*styles), g=strings(*genres)) is want


@pytest.mark.parametrize(
    "raw, want", [("1994-03-00", 1994), ("1996", 1996), (" 1997-09-22", 1997), ("0998", None), ("c. 1994", None), ("", None)]
)
def test_years(spark, raw, want):
    assert one(spark, P.parse_year(F.col("r")), r=raw) == want


@pytest.mark.parametrize(
    "id, name, want",
    [(194, "x", True), (0, "x", True), (5, " Various ", True), (5, "various", False), (5, "Traditional", True), (5, "A", False)],
)
def test_placeholder_artists(spark, id, name, want):
    from crateline.config import PLACEHOLDER_ARTIST_IDS as ids, PLACEHOLDER_ARTIST_NAMES as names

    assert one(spark, P.is_placeholder_artist(F.col("i"), F.col("n"), ids, names), i=id, n=name) is want


def test_placeholder_labels_ignore_case(spark):
    test = P.is_placeholder_label(F.col("n"), "not on label")
    assert [one(spark, test, n=n) for n in ("Not On Label (x)", "  not on LABEL", "On Label")] == [True, True, False]


@pytest.mark.parametrize(
    "seeds, total, want",
    [(61, 77, "high"), (8, 10, "high"), (114, 1079, "medium"), (1, 1, "low"), (25, 5000, "medium"), (61, None, "medium"), (None, None, "none"), (0, 9, "none")],
)
def test_artist_grades(spark, seeds, total, want):
    share = F.col("s") / F.nullif(F.col("t"), F.lit(0))
    as_int = lambda v: F.lit(v).cast("int")
    assert one(spark, P.grade_artist(F.col("s"), share), s=as_int(seeds), t=as_int(total)) == want


@pytest.mark.parametrize("seeds, total, want", [(4, 4, "high"), (3, 7, "medium"), (1, 20, "low"), (1, 1, "low"), (0, 3, "none")])
def test_label_grades(spark, seeds, total, want):
    assert one(spark, P.grade_label(F.col("s"), F.col("t")), s=seeds, t=total) == want


@pytest.mark.parametrize(
    "credits, want",
    [
        (["Producer", "Produced By", "Producer [Produced By]", "Co-producer"], ["Production"]),
        (["Written-By", "Written By", "Songwriter"], ["Writing"]),
        (["Engineer [Additional Engineering]", "Engineer [At Basing Street Studios]"], ["Engineering"]),
        (["Guitar, Bass, Keyboards"], ["Guitar", "Bass", "Keyboards"]),
        (["Engineer [Sigma Sound, New York]"], ["Engineering"]),
        (["Producer", "Producer, Written-By", "Written-By, Mixed By", "Producer [Produced By], Songwriter"], ["Production", "Writing", "Mixing"]),
        (["Design", "Guitar", "Management", "Producer", "Mixed By"], ["Production", "Mixing", "Guitar", "Design", "Management"]),
        (["Producer", "Ondes Martenot"], ["Production", "Ondes Martenot"]),
        (["Zeta", "Alpha [x (y, z), w], Zeta", "Piano"], ["Piano", "Zeta", "Alpha"]),
        (["Alto Saxophone, Electric Guitar, Photography By"], ["Guitar", "Woodwind", "Photography"]),
        ([], []),
        ([""], []),
        (["Drums (open, never, closed"], ["Drums"]),
        (["a ] b, c"], ["a ] b", "c"]),
    ],
)
def test_roles_read_out_loud(spark, credits, want):
    assert one(spark, T.summarise_roles(F.col("c")), c=strings(*credits)) == want


def test_credit_line_and_own_vocabulary(spark):
    assert one(spark, T.credit_line(F.col("c")), c=strings("Producer, Written-By, Mixed By")) == "Production · Writing · Mixing"
    own = [("x", "Ex", 1), ("y", "Why", 0)]
    assert one(spark, T.summarise_roles(F.col("c"), own), c=strings("X", "other", "y")) == ["Why", "Ex", "other"]


def test_split_credit_at_any_depth(spark):
    deep = "A [" + "(" * 12 + "x, y" + ")" * 12 + "], B"
    assert one(spark, T.split_credit(F.col("c")), c=deep) == ["A", "B"]


def parts_by_hand(credit):
    """Walks the characters one by one."""
    parts, depth, part, dropping = [], 0, "", False
    for char in credit + ",":
        if char == "," and depth == 0:
            parts.append(part)
            part, dropping = "", False
            continue
        if char in "[(":
            depth, dropping = depth + 1, True
        elif char in "])":
            depth = max(0, depth - 1)
        if not dropping:
            part += char
    return [" ".join(p.split()) for p in parts if p.split()]


def test_split_credit_against_brute_force(spark):
    draw = random.Random(11)
    credits = ["".join(draw.choice("ab ,,[](x)") for _ in range(draw.randrange(0, 24))) for _ in range(400)]
    # An open bracket at the end swallows the comma the walk adds, so its part ends the text.
    closed = [c for c in credits if depth_of(c) == 0]
    df = spark.createDataFrame([(c,) for c in closed], "c string").select("c", T.split_credit(F.col("c")).alias("got"))
    for row in df.collect():
        assert row.got == parts_by_hand(row.c), row.c
    assert len(closed) > 100


def depth_of(credit):
    depth = 0
    for char in credit:
        depth = depth + 1 if char in "[(" else max(0, depth - 1) if char in "])" else depth
    return depth


def test_connection_wording(spark):
    said = {
        (True, True): "an occasional collaborator and label mate", (True, False): "an occasional collaborator",
        (False, True): "an occasional label mate", (False, False): "an occasional collaborator or label mate",
    }
    for (a, b), want in said.items():
        assert one(spark, P.route(F.col("a"), F.col("b")), a=a, b=b) == want


def test_paths_shares_spans_and_counts(spark):
    paths = {"/core-labels": "/core-labels", "/core-labels/": "/core-labels", "/artist/17111///": "/artist/17111", "/": "/", "": "/", "///": "/"}
    for raw, want in paths.items():
        assert one(spark, T.canonical_path(F.col("p")), p=raw) == want
    for share, want in {0.003: "<1%", 0.0: "0%", 0.154: "15%", 0.155: "16%"}.items():
        assert one(spark, P.share_percent(F.col("s")), s=share) == want
    year = lambda v: F.lit(v).cast("int")
    for (a, z), want in {(1994, 1998): "1994 – 1998", (2003, 2003): "2003", (None, 1990): "? – 1990", (None, None): ""}.items():
        assert one(spark, P.year_span(F.col("a"), F.col("z")), a=year(a), z=year(z)) == want
    parts = lambda *ps: F.array(*[F.struct(F.lit(n).alias("n"), F.lit(w).alias("noun")) for n, w in ps])
    for ps, want in {
        ((43, "collaborator"), (12, "label"), (96, "release")): "43 collaborators, 12 labels and 96 releases",
        ((7, "artist"), (21, "release")): "7 artists and 21 releases",
        ((1, "collaborator"), (1, "label")): "1 collaborator and 1 label",
        ((0, "collaborator"), (3, "label")): "3 labels",
        ((0, "collaborator"), (0, "label")): None,
        ((1987, "release"),): "1,987 releases",
    }.items():
        assert one(spark, P.count_line(F.col("p")), p=parts(*ps)) == want


def test_page_sizes():
    asked = {"12": 40, "100": 100, "5000": 1000, "x": 40, None: 40, "80.9": 80, "": 40, "inf": 40}
    assert {k: V.page_size(k) for k in asked} == asked


def test_search_text_folds_case_accents_and_punctuation(spark):
    assert one(spark, F.trim(T.search_text(F.col("n"))), n="Björk  GUÐMUNDSDÓTTIR!") == "bjork guðmundsdottir"
    hit = lambda name, query: one(
        spark, T.matches_phrase(T.search_text(F.col("n")), T.normalise_query(F.col("q"))), n=name, q=query
    )
    assert hit("Basic Channel", "chan") and hit("Basic Channel", "BASIC-ch") and hit("Basic Channel", "basic channel")
    assert not hit("Basic Channel", "annel") and not hit("Basic Channel", "channel basic") and not hit("Basic", " !! ")


def test_links_keep_one_per_site(spark):
    urls = strings(
        "https://www.facebook.com/a", "http://facebook.com/b", "facebook:foo", "www.noscheme.example", "javascript:x()",
        "http://En.Wikipedia.org/wiki/X", "https://own.example:8080/p q", "http://a.example", "http://b.example", "http://c.example",
    )
    links = one(spark, T.outbound_links(F.col("u")), u=urls)
    assert [(l["name"], l["url"]) for l in links] == [
        ("Facebook", "https://www.facebook.com/a"),
        ("Wikipedia", "http://En.Wikipedia.org/wiki/X"),
        ("own.example", "https://own.example:8080/p q"),
        ("a.example", "http://a.example"),
        ("b.example", "http://b.example"),
    ]
