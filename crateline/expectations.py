"""What a corpus built with the default dials must and must not hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crateline.operators.relational import literal_rows

# --- fixed values: labels that are, and are not, seed labels ---------------------
LABELS_IN = (
    "Chain Reaction", "Basic Channel", "Burial Mix", "Main Street Records", "Echocord",
    "Styrax Leaves", "echospace [detroit]", "Workshop", "Purple Print", "Moonshine Recordings",
    "Ostgut Ton", "Kompakt", "Tresor", "Modern Love",
)
LABELS_OUT = (
    "Sonotec", "E L M", "Top De Luxe", "ARISA", "Stoned Records", "Stars Vintage", "Moonshine Music",
)

# --- fixed values: artists by what must be said of them --------------------------
ARTISTS_IN = (
    "Basic Channel", "Moritz von Oswald", "Mark Ernestus", "Maurizio", "Vainqueur",
    "Rhythm & Sound", "Porter Ricks", "Massive Attack", "The Clash",
)
ARTISTS_HIGH = (
    "Basic Channel", "Rhythm & Sound", "Maurizio", "Vainqueur", "Moritz von Oswald", "Monolake",
    "Porter Ricks", "Jeff Mills",
)
# Neither core, nor high, nor medium.
ARTISTS_NOT_CORE = (
    "Wolfgang Amadeus Mozart", "Ludwig van Beethoven", "The Beatles", "Lady Gaga", "Spice Girls",
    "Iron Maiden", "Black Sabbath", "Manowar", "Frank Sinatra", "Elvis Presley",
)
ARTISTS_BY_LINEAGE = {
    "roots dub": (
        "King Tubby", "Scientist", "Prince Jammy", "Augustus Pablo", "Jah Shaka", "Yabby You",
        "Errol Thompson", "The Roots Radics", "Rhythm & Sound",
    ),
    "afrobeat": ("Fela Kuti", "Antibalas"),
    "detroit techno": (
        "Underground Resistance", "Rhythim Is Rhythim", "Kevin Saunderson", "Octave One", "Theo Parrish",
    ),
    "uk jazz": ("Gilles Peterson", "Matthew Halsall", "Nubya Garcia", "Moses Boyd", "Bradley Zero"),
    "reggae": ("Toots & The Maytals", "Burning Spear", "Culture", "Bob Marley"),
    "acid jazz and DNB": ("Roni Size", "Krust", "Galliano"),
    "dubstep and uk garage": (
        "Burial", "Kode9", "Skream", "Loefah", "Silkie", "Kromestar", "El-B", "MJ Cole",
    ),
}
ARTISTS_NO_LINEAGE = (
    "Sun Ra", "John Zorn", "Peter Brötzmann", "Evan Parker", "Madonna", "Spice Girls", "Björk",
    "Depeche Mode", "Wolfgang Amadeus Mozart", "Basic Channel",
)
ARTISTS_AT_LEAST_MEDIUM = (
    "King Tubby", "Scientist", "Fela Kuti", "Underground Resistance", "Rhythim Is Rhythim",
    "Gilles Peterson", "Matthew Halsall", "Burial", "Kode9", "Skream", "Silkie",
)
ARTISTS_LOW_ONLY = ("Roni Size", "Krust", "Toots & The Maytals", "Bob Marley")


def rows() -> list[tuple[str, str, str, str | None, bool]]:
    """(kind, name, predicate, argument, want) for every default expectation."""
    asked = [
        ("label", LABELS_IN, "is seed label", True),
        ("label", LABELS_OUT, "is seed label", False),
        ("artist", ARTISTS_IN, "in corpus", True),
        ("artist", ARTISTS_NOT_CORE, "is core", False),
        ("artist", ARTISTS_HIGH, "is high", True),
        ("artist", ARTISTS_NOT_CORE, "is high", False),
        ("none", ARTISTS_NO_LINEAGE, "any lineage", False),
        ("medium+", ARTISTS_AT_LEAST_MEDIUM, "at least medium", True),
        ("medium+", ARTISTS_NOT_CORE, "at least medium", False),
        ("low", ARTISTS_LOW_ONLY, "is low", True),
    ]
    plain = [(kind, name, test, None, want) for kind, names, test, want in asked for name in names]
    tagged = [
        (lineage, name, "has lineage", lineage, True)
        for lineage, names in ARTISTS_BY_LINEAGE.items()
        for name in names
    ]
    return plain + tagged


def table(spark: SparkSession) -> DataFrame:
    columns = [
        ("kind", "string"), ("name", "string"), ("predicate", "string"), ("argument", "string"), ("want", "boolean"),
    ]
    return literal_rows(spark, columns, rows())
