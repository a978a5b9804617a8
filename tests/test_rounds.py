"""Relaxation ends by itself or fails; assignment keeps repeated rows at every size."""

import inspect

import pytest

from lattix.operators import bmu, graphs, networks


def test_no_round_limit_and_a_negative_cycle_fails(spark):
    assert "most" not in inspect.signature(graphs.shortest_lengths).parameters and "most" not in inspect.signature(networks.paths).parameters
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, -3.0), (2, 0, 1.0)], "src int, dst int, w double")
    with pytest.raises(ValueError):
        graphs.shortest_lengths(edges, 0)
    with pytest.raises(ValueError):
        networks.paths(edges, spark.createDataFrame([(0,)], "node int"))


def test_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1, 1.0) for k in range(20)], "src int, dst int, w double")
    assert {(r.node, r.dist) for r in graphs.shortest_lengths(edges, 0).collect()} == {(k, float(k)) for k in range(21)}


def test_repeated_rows_stay_with_a_large_codebook(spark, monkeypatch):
    data = spark.createDataFrame([(1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [3.0, 3.0])], "id long, v array<double>")
    codebook = spark.createDataFrame([(k, 0, k, [float(k), float(k)]) for k in range(6)], "nid int, i int, j int, w array<double>")
    small = sorted(map(tuple, bmu.assign(data, codebook).collect()))
    monkeypatch.setattr(bmu, "BLOCK", 4)
    assert sorted(map(tuple, bmu.assign(data, codebook).collect())) == small and len(small) == 3
