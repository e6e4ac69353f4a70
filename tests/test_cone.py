"""Cones of deep chains are whole."""

from __future__ import annotations

import pytest

from gaugeworks.operators import graph


def test_deep_chains_are_followed_to_their_end(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(55)], "src int, dst int")
    start = spark.createDataFrame([(0,)], "node int")
    assert {r.node: r.depth for r in graph.cone(edges, start).collect()} == {k: k for k in range(56)}
    with pytest.raises(ValueError):
        graph.cone(edges, start, limit=2)
