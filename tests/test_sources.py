"""Readers, writers, catalog, geometry, dates and the stream."""

import datetime
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from odweave.functions import geo
from odweave.functions.calendar import week_iso, week_simple, weekday_monday
from odweave.sources import catalog, readers, sinks
from odweave.streaming.availability import availability_stream


def test_text_sources(spark, tmp_path):
    (tmp_path / "clusters.txt").write_text("1,2,3\n4, 5\n\n6\n")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "points.txt").write_text("a,b,c,1.5,2.5\n\nd,e,f,3,4\n")
    got = sorted(map(tuple, readers.read_cluster_list(spark, str(tmp_path / "clusters.txt")).collect()))
    assert got == [(1, 1), (1, 2), (1, 3), (2, 4), (2, 5), (4, 6)]
    assert readers.read_cluster_list(spark, str(tmp_path / "empty.txt")).count() == 0
    assert sorted(map(tuple, readers.read_positions(spark, str(tmp_path / "points.txt"), {3: "x", 4: "y"}).collect())) == [(1.5, 2.5), (3.0, 4.0)]
    np.save(tmp_path / "m.npy", np.arange(6, dtype="float32").reshape(3, 2))
    assert [r.vector for r in readers.read_vectors(spark, str(tmp_path / "m.npy")).orderBy("row").collect()] == [[0, 1], [2, 3], [4, 5]]


def test_matrices_in_parts(spark, tmp_path, monkeypatch):
    from odweave.sources import matrices

    x = np.random.default_rng(1).standard_normal((1_003, 7))
    for name, a in (("b.npy", x[600:].astype("<f4")), ("a.npy", x[:600]), ("c.npy", np.zeros((0, 7)))):
        np.save(tmp_path / name, a)
    spark.dataSource.register(matrices.NpySource)
    df = spark.read.format("npy").option("partbytes", 7 * 8 * 50).load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 12 + 5
    got = [r.vector for r in df.orderBy("path", "row").collect()]
    assert np.array_equal(np.array(got)[:600], x[:600]) and np.array_equal(np.array(got)[600:], x[600:].astype("<f4").astype(float))
    for bad in (np.zeros(3), np.asfortranarray(np.zeros((3, 4))), np.array([["a"]])):
        np.save(tmp_path / "bad.npy", bad)
        with pytest.raises(Exception, match="matrix of numbers"):
            readers.read_vectors(spark, str(tmp_path / "bad.npy")).count()
    (tmp_path / "cut.npy").write_bytes((tmp_path / "a.npy").read_bytes()[:-8])
    with pytest.raises(Exception, match="bytes at row"):
        readers.read_vectors(spark, str(tmp_path / "cut.npy")).count()
    out = tmp_path / "out"
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>").repartitionByRange(3, "id").sortWithinPartitions("id")
    sinks.write_vectors(df, str(out), "v")
    files = sorted(out.glob("*.npy"))
    assert len(files) == 3 and np.array_equal(np.concatenate([np.load(f) for f in files]), x)
    uneven = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "vector array<double>").coalesce(1)
    for odd in (uneven, spark.createDataFrame([(None,)], "vector array<double>"), spark.createDataFrame([([1.0, None],)], "vector array<double>")):
        with pytest.raises(Exception, match="one length without nulls"):
            sinks.write_vectors(odd, str(out))
    sinks.write_vectors(df.limit(0), str(out), "v")
    assert sorted(out.glob("*.npy")) == files
    df.select(F.col("v").alias("vector")).write.format("npy").option("dtype", "<f4").mode("overwrite").save(str(out))
    assert np.array_equal(np.concatenate([np.load(f) for f in sorted(out.glob("*.npy"))]), x.astype("<f4"))


def test_trip_schemas(spark):
    raw = spark.createDataFrame([("01.02.2023", "10:00:00", "01.02.2023", "10:05:00", 300.0, 900.0, 51.0, 7.0, 51.1, 7.1), (None, None, None, None, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0)], "start_date string, start_time string, end_date string, end_time string, `duration [s]` double, `distance [m]` double, a double, b double, c double, d double")
    got = readers.campaign_trips(raw, ("a", "b"), ("c", "d")).collect()
    assert len(got) == 1 and got[0].start_datetime == datetime.datetime(2023, 2, 1, 10) and got[0].gender is None and got[0].source == "sr"
    scooter = spark.createDataFrame([("s", datetime.datetime(2023, 1, 1), datetime.datetime(2023, 1, 1, 1), 1.0, 2.0, 3.0, 4.0, 60.0, 5.0, "r")], "scooter_id string, start_time timestamp, dest_time timestamp, start_loc_lat double, start_loc_lon double, dest_loc_lat double, dest_loc_lon double, duration double, distance double, ride string")
    assert readers.scooter_trips(scooter).schema == readers.TRIP or readers.scooter_trips(scooter).columns == readers.TRIP.fieldNames()


def test_snapshot_stride(spark, tmp_path):
    for i in range(11):
        spark.range(1).select(F.lit(i).alias("v")).coalesce(1).write.parquet(str(tmp_path / "w" / f"{i:02d}"))
        part = next((tmp_path / "w" / f"{i:02d}").glob("part-*"))
        (tmp_path / "flat").mkdir(exist_ok=True)
        part.rename(tmp_path / "flat" / f"{i:02d}.parquet")
    assert sorted(r.v for r in readers.snapshots(spark, str(tmp_path / "flat")).collect()) == [0, 5, 10]


def test_sinks(spark):
    p = spark.createDataFrame([(1, 3, 5), (1, 2, 4), (2, 3, 6)], "i long, j long, d int")
    assert sorted(map(tuple, sinks.distance_objects(p).collect())) == [(1, '{"2":4,"3":5}'), (2, '{"3":6}')]
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (1, None)], "id long, v string")
    assert sorted(map(tuple, sinks.updated(base, new, "id", ["v"]).collect())) == [(1, "a"), (2, "c")]
    assert sinks.poly_lines("x", [(0, 0), (1, 0), (1, 1)])[-3:] == [" 0.0000000 0.0000000", "END", "END"]


def test_catalog(spark):
    name = catalog.namespace("trips", 250, 9, "2", 3, 50000)
    assert name == "trips_min250m_kw9_wdays2_3m_buffer50000m"
    catalog.create_namespace(spark, "exp")
    spark.sql("DROP TABLE IF EXISTS exp.snn1_cl2")
    spark.range(3).write.mode("overwrite").saveAsTable("exp.snn1_cl2")
    assert catalog.point_cluster_tables(spark, "exp") == ["snn1_cl2"] and catalog.network_cluster_tables(spark, "exp") == []
    assert "exp" in catalog.namespaces(spark)
    spark.sql("DROP DATABASE exp CASCADE")
    df = spark.range(1).select(F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y")).alias("geom"))
    assert catalog.geometry_column(df) == ("geom", "POINT") and catalog.srid_of(catalog.with_srid(df, "geom", 32632), "geom") == 32632


def test_utm_and_dates(spark):
    e, n = geo.utm(F.col("lat"), F.col("lng"))
    r = spark.createDataFrame([(51.0, 7.0), (0.0, 9.0), (48.5, 9.0)], "lat double, lng double").select(e.alias("e"), n.alias("n")).collect()
    assert r[1].e == pytest.approx(500000) and r[1].n == pytest.approx(0, abs=1e-6)
    assert r[2].e == pytest.approx(500000, abs=1e-6) and r[2].n == pytest.approx(0.9996 * 5373785.3, rel=1e-3)
    assert 359000 < r[0].e < 360000 and 5651000 < r[0].n < 5653000
    d = spark.createDataFrame([(datetime.date(2024, 1, 8),), (datetime.date(2023, 1, 1),)], "d date").select(week_simple(F.col("d")).alias("s"), week_iso(F.col("d")).alias("i"), weekday_monday(F.col("d")).alias("w"))
    assert [tuple(x) for x in d.collect()] == [(2, 2, 1), (1, 52, 7)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=40))
def test_hull_properties(points):
    h = geo.convex_hull([(float(x), float(y)) for x, y in points])
    n = len(h)
    if n > 2:
        for (ax, ay), (bx, by) in zip(h, [*h[1:], h[0]], strict=True):
            assert all((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= 0 for x, y in points)
        assert geo.convex_overlap(h, h) == pytest.approx(geo.area(h))
        moved = [(x + 100, y) for x, y in h]
        assert geo.convex_overlap(h, moved) == 0


def test_overlap_area():
    a = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    b = [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]
    assert geo.convex_overlap(a, b) == pytest.approx(1) and geo.centroid(a) == (1, 1)
    rnd = random.Random(3)
    r = math.hypot(rnd.random(), 1)
    assert geo.area([(0, 0), (r, 0), (r, r)]) == pytest.approx(r * r / 2)


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    t = datetime.datetime(2024, 1, 1, 8, 0, 30)
    spark.createDataFrame([(t, 1), (t, 1), (t, 2), (t + datetime.timedelta(minutes=1), 1)], "time_stamp timestamp, cluster int").write.parquet(src)
    q = availability_stream(spark, src).writeStream.outputMode("complete").format("memory").queryName("avail").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.time_stamp.minute, r.cluster, r["count"]) for r in spark.table("avail").collect()) == [(0, 1, 2), (0, 2, 1), (1, 1, 1)]
