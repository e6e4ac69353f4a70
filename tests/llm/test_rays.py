"""Rays of a star meet where they may link, and not for what many of them share."""

from __future__ import annotations

import random

import pytest

from gaugeworks.llm import near_dedup
from gaugeworks.llm.store import Scratch

_KIND = "hub long, hub_n int, rep long, n int, lost array<long>, added array<long>, link boolean, comp long"


def star(hub, size, made):
    """Rows of rays from (lost, added) of a hub of ``size`` items."""
    rows = []
    for k, (lost, added) in enumerate(made):
        n = size - len(lost) + len(added)
        link = 185 * (size - len(lost)) >= 85 * (size + n)
        rows.append((hub, size, 1000 * hub + k, n, sorted(lost), sorted(added), link, hub if link else 1000 * hub + k))
    return rows


def links(rows):
    found = set()
    for i, u in enumerate(rows):
        for y in rows[i + 1 :]:
            if u[0] == y[0] and u[7] != y[7]:
                shared = u[1] - len({*u[4], *y[4]}) + len({*u[5]} & {*y[5]})
                if 185 * shared >= 85 * (u[3] + y[3]):
                    found.add((u[0], *sorted((u[2], y[2]))))
    return found


def met(spark, rows, name):
    scratch = Scratch(spark, name)
    out = near_dedup.meeting(scratch.table(spark.createDataFrame(rows, _KIND), "rays"), 85, scratch)
    return {(r.hub, *sorted((r.a, r.b))) for r in out.collect()}


@pytest.mark.parametrize("seed", range(4))
def test_no_link_between_rays_is_missed(spark, seed):
    rng = random.Random(seed)
    rows = []
    for hub, size in enumerate((20, 60, 200)):
        # families of rays that lost and added nearly the same, near the edge of a link with the hub and of one with each other
        made = []
        for _ in range(10):
            lost = set(rng.sample(range(size), rng.randint(0, size // 6)))
            added = {1000 + rng.randrange(3 * size) for _ in range(rng.randint(0, size // 6))}
            for _ in range(6):
                few = rng.randint(0, 1 + size // 12)
                made.append((({*lost} - set(rng.sample(sorted(lost), min(few, len(lost))))) | set(rng.sample(range(size), few)), added | {1000 + rng.randrange(3 * size) for _ in range(few)} | {500, 501}))
        rows += star(hub, size, made)
    want, got = links(rows), met(spark, rows, "rays")
    assert want and want <= got, len(want - got)
    assert any(r[6] for r in rows) and not all(r[6] for r in rows)


@pytest.mark.parametrize(("size", "lose", "most"), [(100, 10, 0.06), (4000, 400, 0.25)])
def test_a_footer_pairs_no_rays(spark, size, lose, most):
    """Each ray has lost and added a tenth, a fifth of what it added shared by all: none may link, and hardly any meet."""
    for rays in (100, 300):
        rng = random.Random(rays)
        footer = set(range(10**6, 10**6 + lose // 5))
        made = [(set(rng.sample(range(size), lose)), footer | {10**7 + 10**4 * k + j for j in range(lose - len(footer))}) for k in range(rays)]
        rows = star(7, size, made)
        assert not any(r[6] for r in rows) and not links(rows)
        assert len(met(spark, rows, "footer")) <= most * rays * (rays - 1) / 2
