"""Registered queries against their SQL over the smallest tables; all names have a callable."""

import duckdb
import pytest

from odweave.plans import catalogue, catalogue_hulls, catalogue_more, catalogue_streets, catalogue_sweeps

SF = "/root/testdata/sf0.001"
MODULES = (catalogue, catalogue_more, catalogue_hulls, catalogue_streets, catalogue_sweeps)
QUERIES, ORACLES = ({k: v for m in MODULES for k, v in getattr(m, name).items()} for name in ("QUERIES", "ORACLES"))
#: These run another query several times over.
SLOW = {"snn_sweep"}
STREETS = ["street_components", "street_node_distances", "grown_networks_induced", "street_snap", "street_samples", "street_cuts", "extents_met", "points_in_extents", "notched_overlaps", "lines_as_text", "polygons_as_text", "sweep_labels"]
CORE = ["snn_clusters", "knn_flows", "dbscan_flows", "snap_od_points", "flow_network_distance", "trips_per_date_complete", "rel_availability_profile", "internal_indices", "subset_windows", "dangling_edges", "cluster_stats", "flows_in_clusters", "knn_of_flows", "kdist_graph", "jarvis_patrick_flows", "silhouette_flows"]


def test_names():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) == sum(len(m.QUERIES) for m in MODULES) > 140


@pytest.mark.parametrize("name", [*CORE, *sorted(set(catalogue_more.ORACLES) - SLOW), *catalogue_hulls.ORACLES, *STREETS])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "events", "labels", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    rel = con.sql(ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    got = sorted(repr(tuple(float(r[c]) if isinstance(r[c], float) else str(r[c]) for c in cols)) for r in df.collect())
    at = [rel.columns.index(c) for c in cols]
    want = sorted(repr(tuple(float(r[i]) if isinstance(r[i], float) else str(r[i]) for i in at)) for r in rel.fetchall())
    assert got == want
