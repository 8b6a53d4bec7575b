"""Role strings, names, links and paths as built-in column expressions."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from crateline.config import KNOWN_HOSTS, LINK_LIMIT
from crateline.functions.vocabulary import NAMES, default_vocabulary

_CUT = "\u0001"


def _tidy(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def split_credit(role: Column) -> Column:
    """Roles in one credit: cut at commas outside brackets, qualifiers dropped.

    Walks bracket, comma and text tokens with the open depth, so any nesting and any
    unclosed bracket is exact. Once a part has opened a bracket the rest of it is dropped.
    """
    tokens = F.regexp_extract_all(role, F.lit(r"[\[\](),]|[^\[\](),]+"), F.lit(0))
    start = F.struct(
        F.lit(0).alias("depth"), F.lit(False).alias("dropping"), F.lit("").alias("kept")
    )

    def step(state: Column, token: Column) -> Column:
        opens = token.isin("[", "(")
        closes = token.isin("]", ")")
        cuts = (token == ",") & (state["depth"] == 0)
        depth = (
            F.when(opens, state["depth"] + 1)
            .when(closes, F.greatest(F.lit(0), state["depth"] - 1))
            .otherwise(state["depth"])
        )
        dropping = F.when(cuts, F.lit(False)).otherwise(opens | state["dropping"])
        kept = (
            F.when(cuts, F.concat(state["kept"], F.lit(_CUT)))
            .when(opens | state["dropping"], state["kept"])
            .otherwise(F.concat(state["kept"], token))
        )
        return F.struct(depth.alias("depth"), dropping.alias("dropping"), kept.alias("kept"))

    kept = F.aggregate(tokens, start, step, lambda state: state["kept"])
    # Most credits hold no bracket at all and need no walk.
    flat = F.when(role.rlike(r"[\[(\])]"), kept).otherwise(F.translate(role, ",", _CUT))
    return F.filter(F.transform(F.split(flat, _CUT), _tidy), lambda part: part != "")


def role_key(role: Column) -> Column:
    return _tidy(F.regexp_replace(F.lower(role), "[-_/]+", " "))


def _vocabulary_lookup(vocabulary: Sequence[tuple[str, str, int]], key: Column) -> Column:
    """(rank, name) of a key, from the vocabulary as a literal map, folded once by the planner."""
    held = {word: {"rank": rank, "name": name} for word, name, rank in vocabulary}
    return F.from_json(F.lit(json.dumps(held)), "map<string,struct<rank:int,name:string>>")[key]


def summarise_roles(
    credits: Column, vocabulary: Sequence[tuple[str, str, int]] | None = None
) -> Column:
    """Credits to the roles a row states, once each, known ones first in order; none for null.

    Works within the row: no explode, no shuffle.
    """
    credits = F.coalesce(credits, F.array().cast("array<string>"))
    entries = default_vocabulary() if vocabulary is None else list(vocabulary)
    unknown = len(NAMES) if vocabulary is None else 1 + max((r for *_, r in entries), default=-1)
    def named(part: Column) -> Column:
        # One-element arrays, so the key and the entry are each worked out once.
        hits = F.transform(F.array(role_key(part)), lambda key: _vocabulary_lookup(entries, key))
        return F.transform(
            hits,
            lambda hit: F.struct(
                F.coalesce(hit["rank"], F.lit(unknown)).alias("rank"),
                F.coalesce(hit["name"], part).alias("name"),
            ),
        )[0]

    said = F.array_distinct(F.transform(F.flatten(F.transform(credits, split_credit)), named))
    placed = F.transform(
        said, lambda r, i: F.struct(r["rank"].alias("rank"), i.alias("at"), r["name"].alias("name"))
    )
    return F.transform(F.array_sort(placed), lambda r: r["name"])


def credit_line(credits: Column, vocabulary: Sequence[tuple[str, str, int]] | None = None) -> Column:
    return F.array_join(summarise_roles(credits, vocabulary), " · ")


def split_lines(text: Column) -> Column:
    """Newline-joined text to its lines; missing text holds none."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.filter(lines, lambda line: line != "")


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """Letters made of one base and one mark, and those bases, by Unicode decomposition."""
    marked, bare = [], []
    for code in range(0xC0, 0x10000):
        char = chr(code)
        parts = unicodedata.normalize("NFD", char)
        if len(parts) == 2 and unicodedata.combining(parts[1]) and char == char.lower():
            marked.append(char)
            bare.append(parts[0])
    return "".join(marked), "".join(bare)


def search_text(name: Column) -> Column:
    """Case- and accent-folded tokens, each led by one blank, for phrase matching."""
    marked, bare = accent_table()
    folded = F.translate(F.regexp_replace(F.lower(name), r"\p{Mn}+", ""), marked, bare)
    return F.regexp_replace(
        F.concat(F.lit(" "), F.regexp_replace(folded, r"[^\p{L}\p{N}\p{Co}]+", " ")), " +", " "
    )


def normalise_query(query: Column) -> Column:
    """The phrase a search box means, in ``search_text`` form; null when it says nothing."""
    text = F.rtrim(search_text(query))
    return F.when(text != "", text)


def matches_phrase(text: Column, phrase: Column) -> Column:
    """Consecutive tokens, the last one a prefix."""
    return F.coalesce(F.contains(text, phrase), F.lit(False))


def http_host(url: Column) -> Column:
    """Host of a http(s) address without "www."; null for anything else."""
    shape = r"(?i)^\s*https?:[/\\]*(?:[^/?#\\@]*@)?([^/?#\\:\s<>^|%@]+)(?::[0-9]*)?(?:[/?#\\].*)?$"
    host = F.lower(F.regexp_extract(F.regexp_replace(url, r"[\t\r\n]", ""), shape, 1))
    bare = F.regexp_replace(host, r"^www\.", "")
    return F.when(bare != "", bare)


def site_name(url: Column, known_hosts: Sequence[tuple[str, str]] = KNOWN_HOSTS) -> Column:
    host = http_host(url)
    name = F.when(host.isNull(), F.lit(None).cast("string"))
    for suffix, site in known_hosts:
        name = name.when(host.endswith(suffix), F.lit(site))
    return name.otherwise(host)


def outbound_links(
    urls: Column,
    known_hosts: Sequence[tuple[str, str]] = KNOWN_HOSTS,
    limit: int = LINK_LIMIT,
) -> Column:
    """First link per site name in listed order, at most ``limit``, as array<struct>."""
    named = F.transform(
        urls, lambda u: F.struct(site_name(u, known_hosts).alias("name"), u.alias("url"))
    )
    none = F.array().cast("array<struct<name:string,url:string>>")

    def step(links: Column, link: Column) -> Column:
        skip = (
            link["name"].isNull()
            | (F.size(links) >= limit)
            | F.exists(links, lambda held: held["name"] == link["name"])
        )
        return F.when(skip, links).otherwise(F.array_append(links, link))

    return F.aggregate(named, none, step)


def canonical_path(path: Column) -> Column:
    bare = F.regexp_replace(path, "/+$", "")
    return F.when(bare == "", "/").otherwise(bare)
