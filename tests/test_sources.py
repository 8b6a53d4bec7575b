import gzip
import json

import pytest
from helpers import catalogue, corpus, values
from pyspark.sql import functions as F

from crateline.config import SERVED, Dials, SceneLists
from crateline.operators import corpus as C
from crateline.operators import entities as E
from crateline.operators import relational as R
from crateline.operators import serve as V
from crateline.plans import steps
from crateline.plans import staging
from crateline.plans.staging import Stage, shared_folder, tune
from crateline.sources import readers, tables

RELEASES = """<?xml version="1.0" encoding="UTF-8"?>
<releases>
<release id="7" status="Accepted">
  <title>First &amp; last</title>
  <artists>
    <artist><id>10</id><name>Häns</name><join>&amp;</join><role/></artist>
    <artist><id>11</id><name> Two </name><join/><role/></artist>
  </artists>
  <labels><label catno=" X-1 " name="One" id="500"/><label name="Two" id="501" catno=""/><label name="Not On Label" catno="N"/></labels>
  <extraartists>
    <artist><id>20</id><name>Eng</name><role>Engineer [Room A, Berlin]</role></artist>
    <artist><id></id><name>Nobody</name><role>Producer</role></artist>
  </extraartists>
  <genres><genre>Electronic</genre></genres>
  <styles><style>Dub Techno</style><style>Techno</style></styles>
  <released>1994-03-00</released>
  <tracklist><track><title>Inner</title>
    <artists><artist><id>998</id><name>Track</name></artist></artists>
    <extraartists><artist><id>999</id><name>Track</name><role>Remix</role></artist></extraartists>
  </track></tracklist>
</release>
<release id="8"><title>Bare</title><artists><artist><id>194</id><name>Various</name></artist></artists><extraartists/><tracklist/></release>
</releases>
"""
ARTISTS = """<artists>
<artist><id>10</id><name>Act</name><realname>A &amp; B</realname><profile>Line one
Line two</profile>
 <urls><url>http://a.example</url><url></url><url>http://b.example</url></urls>
 <namevariations><name>Akt</name></namevariations>
 <aliases><name id="11">Other</name></aliases>
 <members><id>20</id><name id="20">Mem</name><name>No id</name></members></artist>
<artist><id>20</id><name>Mem</name><groups><name id="10">Act</name></groups></artist>
<artist><name>Lost</name></artist>
</artists>
"""
LABELS = """<labels>
<label><id>500</id><name>Top</name><profile/><sublabels><label id="502">Sub</label><label id="503">Sub b</label></sublabels></label>
<label><id>501</id><name>Next</name><urls><url>http://l.example</url></urls></label>
</labels>
"""


@pytest.fixture(scope="module")
def dump(tmp_path_factory):
    folder = tmp_path_factory.mktemp("dump")
    for name, text in (("releases", RELEASES), ("artists", ARTISTS), ("labels", LABELS)):
        (folder / f"{name}.xml").write_text(text, "utf-8")
        (folder / f"{name}.xml.gz").write_bytes(gzip.compress(text.encode("utf-8")))
    return folder


@pytest.mark.parametrize("suffix", ["xml", "xml.gz"])
def test_read_releases(spark, dump, suffix):
    rows = {r.id: r for r in readers.read_releases(spark, f"{dump}/releases.{suffix}").collect()}
    first, bare = rows[7], rows[8]
    assert (first.title, first.year, bare.year) == ("First & last", 1994, None)
    assert [tuple(a) for a in first.artists] == [(10, "Häns", "&"), (11, "Two", None)]
    assert [tuple(c) for c in first.credits] == [(20, "Eng", "Engineer [Room A, Berlin]"), (0, "Nobody", "Producer")]
    assert [tuple(l) for l in first.labels] == [(500, "One", "X-1"), (501, "Two", None), (None, "Not On Label", "N")]
    assert (first.styles, first.genres) == (["Dub Techno", "Techno"], ["Electronic"])
    assert [tuple(a) for a in bare.artists] == [(194, "Various", None)]
    assert (bare.credits, bare.labels, bare.styles, bare.genres) == ([], [], [], [])


def test_read_entities(spark, dump):
    rows = {r.id: r for r in readers.read_artists(spark, f"{dump}/artists.xml").collect()}
    assert set(rows) == {10, 20}
    act = rows[10]
    assert (act.name, act.real_name, act.profile) == ("Act", "A & B", "Line one\nLine two")
    assert act.urls == ["http://a.example", "http://b.example"]
    assert [tuple(r) for r in act.relations] == [("alias", 11, "Other"), ("member", 20, "Mem")]
    assert [tuple(r) for r in rows[20].relations] == [("group", 10, "Act")] and rows[20].real_name is None
    labels = readers.read_labels(spark, f"{dump}/labels.xml")
    assert values(labels, "id", "name", "profile", "urls") == [(500, "Top", None, []), (501, "Next", None, ["http://l.example"])]


def test_malformed_dumps_abort(spark, tmp_path):
    (tmp_path / "bad.xml").write_text('<releases><release id="1"><title>x</release></releases>')
    with pytest.raises(Exception):
        readers.read_releases(spark, str(tmp_path / "bad.xml")).collect()


def test_bronze_is_read_back_whole(spark, dump, tmp_path):
    back = readers.to_bronze(readers.read_releases(spark, f"{dump}/releases.xml.gz"), str(tmp_path / "bronze"))
    assert values(back, "id") == [7, 8]


def test_the_last_of_repeated_records_counts(spark, tmp_path):
    release = '<release id="{}"><artists>{}</artists><title>{}</title></release>'
    artist = "<artist><id>{0}</id><name>A{0}</name></artist>"
    first = [release.format(i, artist.format(i) + artist.format(i + 1), "old") for i in range(1, 60)]
    again = [release.format(i, artist.format(i), "new") for i in range(1, 60, 2)]
    (tmp_path / "releases.xml").write_text("<releases>" + "".join(first + again) + "</releases>")
    back = readers.to_bronze(readers.read_releases(spark, str(tmp_path / "releases.xml")), str(tmp_path / "bronze"))
    assert values(back, "id", "title") == sorted(((i, "new" if i % 2 else "old") for i in range(1, 60)), key=str)
    made = tables.corpus_tables(C.flatten(back), Dials())
    assert made["releases"].count() == 59 and made["release_artists"].count() == 30 + 2 * 29


def test_snapshots(spark):
    names = [f"x_{d}_{t}.xml.gz" for d, ts in {"20260701": "alr", "20260801": "alr", "20260901": "al"}.items() for t in
             ({"a": "artists", "l": "labels", "r": "releases"}[c] for c in ts)] + ["x_20260901_releases.xml.part"]
    files = spark.createDataFrame([(n,) for n in names], "name string")
    need = ("artists", "labels", "releases")
    assert readers.require_snapshot(readers.latest_complete_snapshot(files, need)) == "20260801"
    assert readers.require_snapshot(readers.latest_complete_snapshot(files, need, "20260701")) == "20260701"
    with pytest.raises(LookupError):
        readers.require_snapshot(readers.latest_complete_snapshot(files, need, "20260901"), "20260901")
    dated = spark.createDataFrame([("a.xml.gz", 2), ("z.xml.gz", 1), ("b.xml", 9)], "name string, modified int")
    assert values(readers.newest_file(dated, ".xml.gz"), "name") == ["a.xml.gz"]
    assert values(readers.sample_snapshot(spark.range(50).repartition(5), 3), "id") == [0, 1, 2]


def test_publish_swaps_whole_versions(spark, tmp_path):
    dest = str(tmp_path / "serving")
    with pytest.raises(tables.NoData):
        tables.load_serving(spark, dest)
    artists = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, name string")
    tables.publish_serving({"artists": artists, "seed_labels": artists}, dest)
    assert set(tables.load_serving(spark, dest)) == {"artists"}
    tables.publish_serving({"artists": artists.filter("id = 2")}, dest)
    assert values(tables.load_serving(spark, dest)["artists"], "name") == ["b"]
    # A reader's version outlives the swap; old ones go, and no half-written manifest is left.
    held = tables.load_serving(spark, dest)["artists"]
    for _ in range(2):
        tables.publish_serving({"artists": artists, "people_once": artists}, dest)
    assert values(held, "name") == ["b"]
    tables.publish_serving({"artists": artists}, dest)
    left = sorted(p.name for p in (tmp_path / "serving").iterdir() if not p.name.startswith("."))
    assert len(left) == 4 and left[-1] == "CURRENT" or "CURRENT" in left and len(left) == 4


def test_run_log_appends(spark, tmp_path):
    path = str(tmp_path / "runs")
    for step in ("pass1", "pass2"):
        tables.append_run(spark, tables.run_record({"rows": 3}, step, None, {"dial": 1}, "2026-01-01T00:00:00"), path)
    rows = tables.read_runs(spark, path)
    assert values(rows, "step", "config_json", "stats_json") == [(s, '{"dial": 1}', '{"rows": 3}') for s in ("pass1", "pass2")]


def test_corpus_tables_are_rebuilt_not_layered(spark, tmp_path):
    for releases in ([{"id": 1, "artists": [1]}, {"id": 2, "artists": [2]}], [{"id": 2, "artists": [3]}]):
        tables.rebuild(tables.corpus_tables(catalogue(spark, *releases), Dials()), str(tmp_path))
    assert values(spark.read.parquet(f"{tmp_path}/release_artists"), "release_id", "artist_id") == [(2, 3)]


def test_stage_writes_once_in_the_named_folder(spark):
    stage = Stage(spark)
    assert stage.folder.startswith(shared_folder(spark))
    built = []
    make = lambda: built.append(1) or spark.range(3)
    both = stage.tables({"a": make, "b": lambda: spark.range(2)})
    assert (stage.table("a", make).count(), both["b"].count(), len(built)) == (3, 2, 1)
    with pytest.raises(ZeroDivisionError):
        stage.tables({"c": lambda: 1 // 0})


def test_shuffles_start_with_partitions_for_the_input(spark, dump):
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    assert staging.stored_bytes(spark, f"{dump}/releases.xml") == (dump / "releases.xml").stat().st_size
    tune(spark, 5 << 30)
    assert spark.conf.get(name) == "5"
    spark.conf.unset(name)
    tune(spark, 1000)
    assert spark.conf.get(name, None) is None


# --- entities -----------------------------------------------------------------------------------


def test_entities_are_restricted_named_and_counted(spark, dump):
    artists = readers.read_artists(spark, f"{dump}/artists.xml")
    labels = readers.read_labels(spark, f"{dump}/labels.xml")
    held = corpus(spark, {"id": 1, "artists": [(10, "B"), (33, "Zed")], "credits": [(33, "Mixed By")], "labels": [500, 777]})
    members, refs = held["corpus_artists"], held["release_labels"]
    kept = E.corpus_artist_entities(artists, members)
    named = E.fallback_names(kept, members.select(F.col("artist_id").alias("id")), E.artist_name_refs(held["release_artists"], held["release_credits"]))
    assert values(named, "id", "name") == [(10, "Act"), (33, "Artist 33")]
    kept_labels = E.corpus_label_entities(labels, refs)
    all_labels = E.fallback_names(kept_labels, refs.select(F.col("label_id").alias("id")), E.label_name_refs(refs))
    assert values(all_labels, "id", "name") == [(500, "Top"), (777, "Label 777")]
    relations = E.artist_relations(artists, members)
    assert values(relations, "artist_id", "related_id", "kind", "related_name") == [(10, 11, "alias", "Other"), (10, 20, "member", "Mem")]
    stats = E.entity_stats(artists, labels, kept, kept_labels, members, refs, relations).head().asDict()
    assert stats == {
        "artists_scanned": 2, "artists_kept": 1, "artists_missing": 1, "labels_scanned": 2, "labels_kept": 1, "labels_missing": 1, "relations": 2,
    }


def test_the_last_record_of_an_entity_counts(spark, tmp_path):
    kinds = "id bigint, name string, real_name string, profile string, urls array<string>, relations array<struct<kind:string,id:bigint,name:string>>"
    first = [(1, "Old", "x", "x", ["u"], [("alias", 7, "Gone")]), (2, "B", None, None, [], [])]
    dump = spark.createDataFrame(first, kinds).unionByName(spark.createDataFrame([(1, "New", None, None, [], [("alias", 8, "Kept")])], kinds))
    held = corpus(spark, {"id": 1, "artists": [1, 2], "labels": [1]})
    stage = Stage(spark)
    made = steps.load_entities(held, dump, dump.select("id", "name", "profile", "urls"), stage)
    assert values(made["artists"], "id", "name", "real_name") == [(1, "New", None), (2, "B", None)]
    assert values(made["labels"], "id", "name") == [(1, "New")]
    assert values(made["artist_relations"], "artist_id", "related_id") == [(1, 8)]
    assert steps.entity_stats(stage) == {
        "artists_scanned": 3, "artists_kept": 2, "artists_missing": 0, "labels_scanned": 3, "labels_kept": 1, "labels_missing": 0, "relations": 1,
    }


def test_dumps_to_served_tables(spark, dump, tmp_path):
    """The whole way: read three dumps, build, log, publish and load again."""
    nested = readers.to_bronze(readers.read_releases(spark, f"{dump}/releases.xml.gz"), str(tmp_path / "bronze"))
    d = Dials(label_min_artists=1, label_min_ratio=0.1, scene=SceneLists((10,), (20,), (500,)))
    made = steps.build(
        C.from_records(nested, d.seed), readers.read_artists(spark, f"{dump}/artists.xml"), readers.read_labels(spark, f"{dump}/labels.xml"),
        d, Stage(spark), str(tmp_path / "runs"), "releases.xml.gz",
    )
    tables.publish_serving(made, str(tmp_path / "serving"))
    served = tables.load_serving(spark, str(tmp_path / "serving"))
    assert set(served) == set(SERVED) & set(made) and {"artists", "artist_collaborators", "top_artists"} <= set(served)
    best = V.top_collaborators(served, 10)
    assert values(best, "collaborator_id", "name", "roles") == [(11, "Two", None), (20, "Mem", ["Engineer [Room A, Berlin]"])]
    assert values(V.search(served, "häns").union(V.search(served, "act")), "id", "name") == [(10, "Act")]
    runs = {r.step: r for r in tables.read_runs(spark, str(tmp_path / "runs")).collect()}
    assert set(runs) == {"pass1", "pass2", "entities", "derive"}
    counted = json.loads(runs["pass1"].stats_json)
    assert (counted["scanned"], counted["seed_releases"], counted["labels_without_id"]) == (2, 1, 1)
    assert json.loads(runs["derive"].config_json)["max_people_per_release"] == 20
