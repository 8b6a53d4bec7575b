"""Every threshold and list an operator takes, with the default catalogue's values.

All operators receive these as arguments, so the same code runs on any
release / person / label shaped tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field


# --- fixed values: the seed rule ------------------------------------------------
@dataclass(frozen=True)
class SeedRule:
    core: tuple[str, ...] = ("Dub Techno", "Deep Techno")
    broad: tuple[str, ...] = ("Minimal", "Dub")
    gate_genres: tuple[str, ...] = ("Electronic",)
    needs_companion: tuple[str, ...] = ("Ambient",)
    companions: tuple[str, ...] = ("Techno", "Minimal Techno", "Dub Techno", "Deep Techno")
    disqualifying: tuple[str, ...] = (
        "Modern Classical",
        "Soundtrack",
        "Score",
        "Classical",
        "Opera",
        "Baroque",
        "Romantic",
        "Musical",
        "Spoken Word",
        "Contemporary",
        "Field Recording",
    )


# --- fixed values: role markers, matched as lower-case substrings ---------------
PACKAGING_ROLES = (
    "photograph",
    "artwork",
    "design",
    "illustration",
    "layout",
    "sleeve",
    "liner notes",
)
AUTHORSHIP_ROLES = (
    "composed by",
    "written-by",
    "written by",
    "music by",
    "words by",
    "text by",
    "lyrics by",
)

# --- fixed values: stand-ins that are not people or labels ----------------------
PLACEHOLDER_ARTIST_IDS = (194,)
PLACEHOLDER_ARTIST_NAMES = ("Various", "Unknown Artist", "No Artist", "Traditional")
PLACEHOLDER_LABEL_PREFIX = "not on label"
# The top lists use their own, different exclusion.
LIST_EXCLUDED_IDS = (355,)
LIST_EXCLUDED_NAMES = ("Various", "UNKNOWN ARTIST", "No Artist")


@dataclass(frozen=True)
class Grades:
    """Artist and label grade thresholds; the defaults are fixed values."""

    high_min_releases: int = 5
    high_min_share: float = 0.15
    medium_min_releases: int = 2
    medium_min_share: float = 0.05
    medium_or_releases: int = 20
    label_high_min_artists: int = 2
    label_high_min_ratio: float = 0.5
    label_medium_min_artists: int = 2
    label_medium_min_ratio: float = 0.25


@dataclass(frozen=True)
class Tradition:
    """One lineage rule: by tags (styles and/or genre) or by label ids."""

    name: str
    floor: str
    min_releases: int
    min_share: float
    styles: tuple[str, ...] = ()
    genre: str | None = None
    labels: tuple[int, ...] = ()


# --- fixed values: traditions in order of precedence ----------------------------
TRADITIONS = (
    Tradition("roots dub", "medium", 5, 0.2, styles=("Dub",), genre="Reggae"),
    Tradition("afrobeat", "medium", 5, 0.2, styles=("Afrobeat",)),
    Tradition("dubstep and uk garage", "medium", 5, 0.2, styles=("Dubstep", "UK Garage")),
    Tradition("reggae", "low", 5, 0.2, genre="Reggae"),
    Tradition(
        "detroit techno", "medium", 3, 0.1, labels=(415, 388, 290, 258, 43, 1, 257, 70, 399, 374)
    ),
    Tradition(
        "uk jazz",
        "medium",
        2,
        0.1,
        labels=(62136, 3244, 116373, 695882, 617182, 710676, 755637, 143126, 143129),
    ),
    Tradition("acid jazz and DNB", "low", 3, 0.1, labels=(118, 123224)),
)
LIFTS_FROM = {"medium": ("none", "low"), "low": ("none",)}

# --- fixed values: grades, best first -------------------------------------------
GRADE_ORDER = ("high", "medium", "low", "none")

# --- fixed values: curated ids for the top lists --------------------------------
CORE_ARTISTS = (
    13117, 975, 534, 406, 311802, 16162, 973, 12858, 969, 1092, 18185, 25125, 978, 761268,
    15056, 46691, 104937, 17111, 456229,
)
NAMED_ARTISTS = (
    504831, 97364, 410991, 91, 2718, 156523, 420953, 101867, 40917, 317019, 956978, 1085091,
    4340333, 621780, 6514571, 518103, 967452, 1462833, 1730784, 1342748, 881554, 493156, 214016,
    1993158, 2981236, 933250, 1285, 1189777, 1638817, 891346, 179076, 663311, 4787225, 462786,
    1063359, 5892, 4520172, 530005, 953335, 5104054, 633,
)
SCENE_LABELS = (
    255, 234, 768, 79724, 89598, 715, 144751, 31, 10999, 46981, 207711, 5306, 1465, 393581, 457,
    1851, 132653, 78265, 694039, 980123, 188482, 439777, 478570, 635170, 1707457, 97088, 588461,
    95752, 416176, 669382, 862058, 969622, 246087, 640495, 260, 81833, 178535, 256140, 179045,
    17087, 245, 212599, 985, 59, 594019, 1626, 7647, 9520, 387813, 8367, 120499, 2525,
)


@dataclass(frozen=True)
class SceneLists:
    core_artists: tuple[int, ...] = CORE_ARTISTS
    named_artists: tuple[int, ...] = NAMED_ARTISTS
    scene_labels: tuple[int, ...] = SCENE_LABELS
    alias_floor: int = 10
    excluded_ids: tuple[int, ...] = LIST_EXCLUDED_IDS
    excluded_names: tuple[str, ...] = LIST_EXCLUDED_NAMES


@dataclass(frozen=True)
class Dials:
    """Selection, expansion, derivation and grading dials in one bundle; the defaults are fixed values."""

    seed: SeedRule = field(default_factory=SeedRule)
    packaging_roles: tuple[str, ...] = PACKAGING_ROLES
    authorship_roles: tuple[str, ...] = AUTHORSHIP_ROLES
    placeholder_ids: tuple[int, ...] = PLACEHOLDER_ARTIST_IDS
    placeholder_names: tuple[str, ...] = PLACEHOLDER_ARTIST_NAMES
    placeholder_label_prefix: str = PLACEHOLDER_LABEL_PREFIX
    min_seed_ratio: float | None = 0.02
    label_min_artists: int = 2
    label_min_ratio: float = 0.5
    min_ties: int = 1
    bridge_min_ratio: float | None = 0.1
    max_people_to_admit: int = 8
    max_people_per_release: int = 20
    grades: Grades = field(default_factory=Grades)
    traditions: tuple[Tradition, ...] = TRADITIONS
    scene: SceneLists = field(default_factory=SceneLists)


TOP_LIST_SIZE = 1000
PAGE_SIZE = 40
PAGE_MAX = 1000
SAMPLE_SIZE = 5000
FLOOR_SWEEP = (0.02, 0.05, 0.1, 0.25)

# --- fixed values: link hosts, matched as host suffixes in this order -----------
KNOWN_HOSTS = (
    ("facebook.com", "Facebook"),
    ("wikipedia.org", "Wikipedia"),
    ("twitter.com", "Twitter"),
    ("x.com", "X"),
    ("instagram.com", "Instagram"),
    ("soundcloud.com", "SoundCloud"),
    ("bandcamp.com", "Bandcamp"),
    ("youtube.com", "YouTube"),
    ("mixcloud.com", "Mixcloud"),
    ("residentadvisor.net", "Resident Advisor"),
    ("ra.co", "Resident Advisor"),
    ("myspace.com", "MySpace"),
    ("last.fm", "Last.fm"),
    ("beatport.com", "Beatport"),
)
LINK_LIMIT = 5

# --- fixed values: tables the serving side never reads --------------------------
SERVED = (
    "artists",
    "labels",
    "artist_relations",
    "artist_search",
    "label_search",
    "artist_postings",
    "label_postings",
    "artist_release_list",
    "label_release_list",
    "releases",
    "release_artists",
    "release_credits",
    "release_labels",
    "corpus_artists",
    "artist_collaborators",
    "artist_labels",
    "label_roster",
    "artist_coverage",
    "label_coverage",
    "scene_anchors",
    "scene_releases",
    "top_artists",
    "top_labels",
)
