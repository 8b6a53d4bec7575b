"""The driver's tables read as a catalogue of releases, people and labels.

release = order, person = part, label = supplier, reference = line item; styles are part
brands and the genre is the order priority. ``nested_releases`` builds whole nested records
within one order row, so nothing is gathered per group.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crateline.config import Dials, Grades, SceneLists, SeedRule, Tradition
from crateline.operators.corpus import Catalogue
from crateline.plans.staging import Stage, buckets_for, stored_bytes, tune
from crateline.plans import steps

DIALS = Dials(
    seed=SeedRule(
        core=("Brand#1", "Brand#2"),
        broad=("Brand#3",),
        gate_genres=("1-URGENT",),
        needs_companion=("Brand#4",),
        companions=("Brand#5", "Brand#6"),
        disqualifying=("Brand#25",),
    ),
    placeholder_ids=(7,),
    placeholder_names=("Various", "blue anvil"),
    min_seed_ratio=0.27,
    label_min_artists=2,
    label_min_ratio=0.437,
    min_ties=2,
    bridge_min_ratio=0.35,
    max_people_to_admit=4,
    max_people_per_release=6,
    grades=Grades(
        high_min_releases=5,
        high_min_share=0.3,
        medium_min_releases=3,
        medium_min_share=0.25,
        medium_or_releases=20,
        label_high_min_artists=2,
        label_high_min_ratio=0.437,
        label_medium_min_artists=2,
        label_medium_min_ratio=0.43,
    ),
    traditions=(
        Tradition("tag and genre", "medium", 2, 0.1, styles=("Brand#10", "Brand#11"), genre="2-HIGH"),
        Tradition("one tag", "medium", 4, 0.3, styles=("Brand#12",)),
        Tradition("genre alone", "low", 5, 0.3, genre="3-MEDIUM"),
        Tradition("some labels", "medium", 2, 0.1, labels=(1, 2, 3)),
        Tradition("other labels", "low", 2, 0.1, labels=(4, 5, 6, 8)),
    ),
    scene=SceneLists(
        core_artists=tuple(range(1, 20)),
        named_artists=tuple(range(20, 61)),
        scene_labels=tuple(range(1, 100, 5)),
        alias_floor=2,
        excluded_ids=(11,),
        excluded_names=("Various", "UNKNOWN ARTIST", "No Artist", "blue bolt"),
    ),
)

# The same seed, a wider hop: weaker bridges, fuller releases, one shared release is enough.
WIDER = replace(DIALS, bridge_min_ratio=0.3, max_people_to_admit=6, min_ties=1)
# For the nested records, whose styles are market segments and nations.
NESTED_DIALS = replace(
    DIALS,
    seed=SeedRule(
        core=("Nation style 1", "Nation style 7"),
        broad=("BUILDING",),
        gate_genres=("1-URGENT", "2-HIGH"),
        needs_companion=("MACHINERY",),
        companions=("Nation style 3", "Nation style 8"),
        disqualifying=("Nation style 24",),
    ),
    label_min_ratio=0.4,
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    unsure = (F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P")
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("Order "), F.col("o_orderkey")).alias("title"),
        F.when(~unsure, F.year("o_orderdate")).alias("year"),
    )


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item beside its part, from which the line, the credits and the styles are read."""
    parts = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("artist_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("style")
    )
    items = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("release_id"),
        (F.col("l_linenumber") - 1).alias("position"),
        F.col("l_partkey").alias("artist_id"),
        "l_linestatus",
        "l_returnflag",
    )
    return items.join(parts, "artist_id")


def line(people: DataFrame) -> DataFrame:
    phrase = F.when(F.col("l_returnflag") == "A", "&").when(F.col("l_returnflag") == "R", ",")
    return people.filter("l_linestatus = 'F'").select(
        "release_id", "position", "artist_id", "name", phrase.alias("join_phrase")
    )


def _role():
    return (
        F.when(F.col("position") == 6, "Photography By, Design")
        .when(F.col("l_returnflag") == "A", "Producer [Produced By]")
        .when(F.col("l_returnflag") == "R", "Engineer [Sigma Sound, New York], Mixed By")
        .otherwise("Written-By")
    )


def credits(people: DataFrame) -> DataFrame:
    return people.filter("l_linestatus = 'O'").select(
        "release_id", "position", "artist_id", "name", _role().alias("role")
    )


def on_line_or_credited(people: DataFrame) -> DataFrame:
    """The line, its role null, and the credits, read in one pass."""
    role = F.when(F.col("l_linestatus") == "O", _role())
    return people.filter("l_linestatus IN ('F', 'O')").select("release_id", "artist_id", "name", role.alias("role"))


def label_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    items = read(spark, sf_dir, "lineitem").join(names, "l_suppkey")
    return items.select(
        F.col("l_orderkey").alias("release_id"),
        (F.col("l_linenumber") - 1).alias("position"),
        F.when(F.col("l_tax") <= 0.075, F.col("l_suppkey")).alias("label_id"),
        F.when(F.col("l_suppkey") % 17 == 0, "Not On label (x)").otherwise(F.col("s_name")).alias("name"),
        F.when(
            F.col("l_discount") > 0.005, F.concat(F.lit("CAT "), F.col("l_quantity").cast("int"))
        ).alias("catno"),
    )


def styles(people: DataFrame) -> DataFrame:
    return people.select("release_id", "style").distinct()


def genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("release_id"), F.col("o_orderpriority").alias("genre")
    )


# The tables a catalogue is read from, and the column that names the release.
CATALOGUE_KEYS = {"cat_releases": "id", "cat_people": "release_id", "cat_label_refs": "release_id", "cat_genres": "release_id"}


def catalogue_tables(spark: SparkSession, sf_dir: str, stage: Stage) -> dict[str, DataFrame]:
    """Written once and dealt by release: the joins that name people are not repeated."""
    makes = {"cat_releases": releases, "cat_people": people, "cat_label_refs": label_refs, "cat_genres": genres}
    return stage.tables(
        {name: lambda name=name: stage.deal(makes[name](spark, sf_dir), CATALOGUE_KEYS[name]) for name in makes}
    )


def catalogue(held: dict[str, DataFrame]) -> Catalogue:
    named = held["cat_people"]
    return Catalogue(
        releases=held["cat_releases"],
        line=line(named),
        credits=credits(named),
        label_refs=held["cat_label_refs"],
        styles=styles(named),
        genres=held["cat_genres"],
        people=on_line_or_credited(named),
    )


def profile_text(id_column: str, name: str, kind: str):
    """Profile markup of every form, made from an entity's own key, name and kind."""
    c = F.col
    return F.concat(
        F.lit("[b]From[/b] "), c(kind).cast("string"), F.lit(" with [a"), c(id_column) + 7,
        F.lit("] and [L"), c(id_column) % 120, F.lit("],\nas [a="), c(name), F.lit("] on [url=http://x.example/"),
        c(id_column), F.lit("]its site[/url], not [url=javascript:1][/url] [i]ever[/i]."),
    )


def artists_dump(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """(id, name, real_name, profile, urls, relations) of every part, or of those a dump with
    missing records holds."""
    key = F.col("p_partkey")
    related = F.array(
        F.struct(F.lit("alias").alias("kind"), (key + 7).alias("id"), F.concat(F.lit("Alias "), key + 7).alias("name")),
        F.struct(F.lit("member").alias("kind"), (key + 11).alias("id"), F.lit("Member").alias("name")),
        F.struct(F.lit("group").alias("kind"), (key * 3 + 1).alias("id"), F.lit("").alias("name")),
    )
    kinds = F.when(F.col("p_size") <= 15, F.slice(related, 1, 1)).when(
        F.col("p_size") <= 30, F.slice(related, 2, 2)
    ).otherwise(F.slice(related, 1, 3))
    urls = F.array(
        F.concat(F.lit("https://www.facebook.com/"), key),
        F.concat(F.lit("http://shop.example/"), F.col("p_brand")),
        F.lit("facebook:foo"),
    )
    parts = read(spark, sf_dir, "part")
    return (parts if whole else parts.filter("p_size <= 45 and p_partkey > 0")).select(
        key.alias("id"),
        F.col("p_name").alias("name"),
        F.when(F.col("p_type") != "PROMO", F.col("p_type")).alias("real_name"),
        profile_text("p_partkey", "p_name", "p_type").alias("profile"),
        F.slice(urls, F.lit(1), F.col("p_size") % 4).alias("urls"),
        kinds.alias("relations"),
    )


def labels_dump(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    suppliers = read(spark, sf_dir, "supplier")
    return (suppliers if whole else suppliers.filter("s_nationkey < 20 and s_suppkey > 0")).select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("name"),
        profile_text("s_suppkey", "s_name", "s_nationkey").alias("profile"),
        F.array(F.concat(F.lit("http://label.example/"), F.col("s_suppkey"))).alias("urls"),
    )


def nested_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested record per order, its people and labels made from the order's own columns."""
    customers = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey", "c_mktsegment"
    )
    rows = read(spark, sf_dir, "orders").join(customers, "o_custkey")
    key, who = F.col("o_orderkey"), F.col("o_custkey")
    person = lambda id, name, phrase: F.struct(
        id.alias("id"), name.alias("name"), phrase.cast("string").alias("join_phrase")
    )
    other = who + 1 + key % 5
    credit = lambda id, role: F.struct(
        id.alias("id"), F.concat(F.lit("Person "), id).alias("name"), role.alias("role")
    )
    first = person(who, F.col("c_name"), F.when(F.col("o_orderstatus") == "F", "&"))
    second = person(other, F.concat(F.lit("Person "), other), F.lit(None))
    label = lambda id, name, catno: F.struct(id.alias("id"), name.alias("name"), catno.alias("catno"))
    nation = F.col("c_nationkey").cast("bigint")
    placeholder = F.when(nation % 5 == 0, "Not On Label").otherwise(F.concat(F.lit("Nation "), nation))
    catno = F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("N-"), nation))
    return rows.select(
        key.alias("id"),
        F.concat(F.lit("Order "), key).alias("title"),
        F.year("o_orderdate").alias("year"),
        F.when(F.col("o_orderstatus") == "F", F.array(first, second)).otherwise(F.array(first)).alias("artists"),
        F.when(
            F.col("o_orderpriority") == "1-URGENT",
            F.array(credit(who, F.lit("Producer")), credit(other + 3, F.lit("Engineer [Dub, Mix]"))),
        )
        .when(F.col("o_orderpriority") == "2-HIGH", F.array(credit(other, F.lit("Written-By"))))
        .otherwise(F.array().cast("array<struct<id:bigint,name:string,role:string>>"))
        .alias("credits"),
        F.array(
            label(nation, placeholder, catno),
            label(F.lit(None).cast("bigint"), F.lit("Unlinked"), F.lit("U")),
            label(nation + 100, F.concat(F.lit("Series "), nation), F.lit(None).cast("string")),
        ).alias("labels"),
        F.array("c_mktsegment", F.concat(F.lit("Nation style "), nation)).alias("styles"),
        F.array("o_orderpriority").alias("genres"),
    )


class Bound:
    """Every table of one scale folder, each step's output written once per session."""

    def __init__(self, spark: SparkSession, sf_dir: str, dials: Dials = DIALS):
        size = stored_bytes(spark, f"{sf_dir}/lineitem.parquet")
        self.spark = tune(spark, size)
        self.sf_dir, self.dials, self.buckets = sf_dir, dials, buckets_for(spark, size)
        self.stage = self.new_stage()
        self._made: dict[str, object] = {}

    def new_stage(self) -> Stage:
        """A stage whose tables meet by release without a shuffle."""
        return Stage(self.spark, keys={**CATALOGUE_KEYS, **steps.RELEASE_KEYS}, buckets=self.buckets)

    def _once(self, name, make):
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    @property
    def cat(self) -> Catalogue:
        return self._once("cat", lambda: catalogue(self.cat_tables))

    @property
    def cat_tables(self) -> dict[str, DataFrame]:
        return self._once("cat_tables", lambda: catalogue_tables(self.spark, self.sf_dir, self.stage))

    @property
    def seed(self) -> steps.Seed:
        return self._once("seed", lambda: steps.select_seed(self.cat, self.dials, self.stage))

    @property
    def corpus(self) -> dict[str, DataFrame]:
        return self._once("corpus", lambda: steps.select_corpus(self.cat, self.dials, self.stage))

    @property
    def artists_dump(self) -> DataFrame:
        return artists_dump(self.spark, self.sf_dir)

    @property
    def labels_dump(self) -> DataFrame:
        return labels_dump(self.spark, self.sf_dir)

    @property
    def whole_artists_dump(self) -> DataFrame:
        return artists_dump(self.spark, self.sf_dir, whole=True)

    @property
    def whole_labels_dump(self) -> DataFrame:
        return labels_dump(self.spark, self.sf_dir, whole=True)

    @property
    def entities(self) -> dict[str, DataFrame]:
        return self._once(
            "entities",
            lambda: steps.load_entities(self.corpus, self.artists_dump, self.labels_dump, self.stage),
        )

    @property
    def derived(self) -> dict[str, DataFrame]:
        return self._once(
            "derived",
            lambda: steps.derive(self.corpus, self.entities["labels"], self.dials, self.stage),
        )

    @property
    def tables(self) -> dict[str, DataFrame]:
        return {**self.corpus, **self.entities, **self.derived}

    @property
    def served(self) -> dict[str, DataFrame]:
        """With the tables that lookups read."""
        return {**self.tables, **self._once("serving", lambda: steps.serving_tables(self.tables, self.stage))}


_BOUND: dict[tuple[str, str], Bound] = {}


def bind(spark: SparkSession, sf_dir: str) -> Bound:
    """The binding of one folder in one application, shared by the queries over it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BOUND:
        _BOUND[key] = Bound(spark, sf_dir)
    return _BOUND[key]
