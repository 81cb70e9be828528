"""Sums over all pairs of flows from blocks, against plain joins of pairs."""

import math

import pytest
from pyspark.sql import functions as F

from odweave.operators import blocks, distance
from odweave.plans import catalogue

SF = "/root/testdata/sf0.001"


def _flows(spark):
    rows = [(i + i // 40, *((i * a) % 97 * 10 for a in (7, 31, 53, 11))) for i in range(150)] + [(200, 5, 5, 5, 5), (201, 5, 5, 5, 5), (3, 1, 2, 3, 4), (None, 1, 2, 3, 4), (202, None, 2, 3, 4)]
    return spark.createDataFrame(rows, "flow_id long, ox int, oy int, dx int, dy int")


def _equal(got, want):
    assert sorted(got) == sorted(want) and got
    for i, row in want.items():
        assert all((a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)) for a, b in zip(got[i], row, strict=True)), (i, got[i], row)


@pytest.mark.parametrize("measure", blocks.MEASURES)
def test_summaries_equal_joined_pairs(spark, measure, monkeypatch):
    monkeypatch.setattr(blocks, "TILE", (7, 16))
    f = _flows(spark)
    pairs = distance.flow_pairs(f.dropna(), measure).groupBy("i").agg(F.count("d"), F.sum("d"), F.min("d"), F.max("d"))
    got = blocks.pair_summary(f, "flow_id", distance.FLOW, blocks.MEASURES[measure], measure in blocks.WHOLE, split=5)
    _equal({r[0]: tuple(r)[1:] for r in got.collect()}, {r[0]: tuple(r)[1:] for r in pairs.collect()})


@pytest.mark.parametrize("name", ["flow_pairs_manhattan", "flow_pairs_geom", "distance_minmax", "distance_histogram"])
def test_queries_join_no_pairs(spark, name, monkeypatch):
    monkeypatch.setattr(distance, "half_pairs", None)
    assert catalogue.QUERIES[name](spark, SF).count() == (20 if name == "distance_histogram" else 499)


def test_empty_and_single(spark):
    f = _flows(spark)
    for few in (f.limit(0), f.filter("flow_id = 200")):
        assert blocks.pair_summary(few, "flow_id", distance.FLOW, blocks.manhattan).count() == 0
        assert blocks.pair_histogram(few, "flow_id", distance.FLOW, blocks.manhattan).count() == 0


def test_cluster_sums_ends_and_cvnn_equal_joined_pairs(spark, monkeypatch):
    from odweave.operators import validation, validity

    monkeypatch.setattr(blocks, "TILE", (7, 16))
    f = _flows(spark).dropna().filter("flow_id NOT IN (3, 201)").withColumn("cluster", F.col("flow_id") % 4)
    labels, pairs = f.select(F.col("flow_id").alias("id"), "cluster"), distance.flow_pairs(f)
    got, want = validity.cvnn_flows(f, "flow_id", "cluster", 4).first(), validity.cvnn(pairs, labels, 4).first()
    assert tuple(got) == pytest.approx(tuple(want))
    p = f.withColumnRenamed("flow_id", "id")
    ends = blocks.cluster_ends(p.filter("cluster <> 0"), "id", distance.FLOW, "cluster", blocks.manhattan, split=5)
    assert tuple(validation.internal_indices(p, distance.FLOW, "cluster", ends=ends).first()) == pytest.approx(tuple(validation.internal_indices(p, distance.FLOW, "cluster", pairs).first()))


@pytest.mark.parametrize("name", ["distances_melted", "cvnn", "internal_indices"])
def test_more_queries_join_no_pairs(spark, name, monkeypatch):
    from odweave.plans import catalogue_more

    monkeypatch.setattr(distance, "half_pairs", None)
    assert (catalogue.QUERIES | catalogue_more.QUERIES)[name](spark, SF).count() > 0


def test_blocks_grow_with_the_points(spark):
    """What is shuffled stays a multiple of the points: no more than SPLIT blocks."""
    p = spark.range(3000).select("id", F.lit(1).alias("c"), *[(F.col("id") * a % 97).alias(x) for x, a in zip(distance.FLOW, (7, 31, 53, 11), strict=True)])
    assert blocks._met(p, "id", distance.FLOW, "c", 10).count() == blocks.SPLIT * (blocks.SPLIT + 1) // 2
