"""Mixing against a plain solver: targets, rates and words taken."""

import math
import random

import pytest

from crateline.llm import mixing
from crateline.llm.common import prepare
from crateline.llm.mixing import mix, mixed_documents


@pytest.fixture(scope="module")
def session(spark):
    return prepare(spark)


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, stopped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in stopped]
        level = (total - sum(stopped.values())) / sum(weight[s] for s in free) if free else 0
        above = [s for s in free if level * weight[s] > cap * sizes[s]]
        if not above:
            return stopped | {s: level * weight[s] for s in free}
        stopped |= {s: cap * sizes[s] for s in above}


def documents(session, rows):
    schema = "doc_id bigint, text string, source string, size string, rate string, number bigint"
    return session.createDataFrame([(i, t, s, "x", "y", 9) for i, t, s in rows], schema)


def test_targets_rates_and_copies(session):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        source = rng.choices([None, "a", "b", "ü", "Z", "tiny"], [3, 20, 4, 4, 4, 1])[0]
        rows.append((i, " ".join(["w"] * int(rng.lognormvariate(3, 1))), source))
    rows += [(2000, None, "a"), (2001, "", "b"), (None, "one two", "a"), (2002, "w w w", "empty only"), (2003, " ", "zero")]
    got = mix(documents(session, rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    wanted, taken = plain_targets(sizes), {}
    for r in got:
        assert r.source_size == sizes[r.source]
        assert math.isclose(r.target, wanted[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        assert r.size == 0 or abs(r.copies - r.rate) <= 1
        taken[r.source] = taken.get(r.source, 0) + r.taken
    longest = max(r.size for r in got)
    assert all(abs(taken[s] - wanted[s]) <= longest for s in sizes)
    # Rates are exp(lambda * size), held at the cap: one multiplier per source gives its target.
    for source in sizes:
        own = [r for r in got if r.source == source and r.size > 0 and r.rate < 3]
        slopes = [math.log(r.rate) / r.size for r in own]
        assert not slopes or max(slopes) - min(slopes) <= 1e-9 + 1e-6 * abs(slopes[0])
        words = sum(r.rate * r.size for r in got if r.source == source)
        assert math.isclose(words, wanted[source], rel_tol=1e-3, abs_tol=1e-6)
    again = mix(documents(session, rows)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    assert [r.taken for r in sorted(got, key=key)] == [r.taken for r in sorted(again, key=key)]
    copies = mixed_documents(documents(session, rows))
    assert copies.columns == documents(session, []).columns
    assert copies.count() == sum(r.copies for r in got)


def test_nothing_and_repeats(session):
    assert mix(documents(session, [])).count() == 0
    rows = mix(documents(session, [(1, "a b", None)] * 3)).collect()
    assert [(r.taken, r.target) for r in rows] == [(2, 6.0)] * 3
    assert [r.taken for r in mix(documents(session, [(1, None, "a"), (2, "", None)])).collect()] == [0, 0]


def test_sources_settle_by_halving_alone(session, monkeypatch):
    monkeypatch.setattr(mixing, "STEPS", 0)
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * int(rng.lognormvariate(3, 1))), "aabc"[i % 4]) for i in range(200)]
    got = mix(documents(session, rows)).collect()
    for source in "abc":
        own = [r for r in got if r.source == source]
        assert math.isclose(sum(r.rate * r.size for r in own), own[0].target, rel_tol=1e-4)
