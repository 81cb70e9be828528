"""H2: lookups behind an interactive look at clusters: neighbours of flows, flows of clusters, and sizes of clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo


def knn_of(knn: DataFrame, flows: DataFrame, key: str, ids: list[int], k: int) -> DataFrame:
    """(ref, rank, distance, and the columns of flows) of the k nearest of each of `ids`; knn(ref, rank, nn, distance) as nearest() gives it. An id without neighbours gives no rows."""
    wanted = knn.filter(F.col("ref").isin(ids) & (F.col("rank") <= k)).select("ref", "rank", "distance", F.col("nn").alias("_nn"))
    return flows.join(wanted, F.col(key) == F.col("_nn")).select("ref", "rank", "distance", *[flows[c] for c in flows.columns])


def flows_in_clusters(flows: DataFrame, labels: DataFrame, key: str, clusters: list[int]) -> DataFrame:
    """The flows of some clusters with their label; labels(id, cluster_pred). Label 0 gives the noise."""
    picked = labels.filter(F.col("cluster_pred").isin(clusters)).select(F.col("id").alias("_id"), "cluster_pred")
    return flows.join(picked, F.col(key) == F.col("_id")).drop("_id")


def cluster_stats(labels: DataFrame, flows: DataFrame, key: str) -> DataFrame:
    """(cluster_pred, n_flows, mean_length, share) of each cluster and of noise; share is of all labelled flows. No flows give no rows."""
    long = flows.select(F.col(key).alias("_id"), geo.distance(F.col("ox"), F.col("oy"), F.col("dx"), F.col("dy")).alias("_m"))
    per = labels.join(long, F.col("id") == F.col("_id")).groupBy("cluster_pred").agg(F.count("*").alias("n_flows"), F.avg("_m").alias("mean_length"))
    total = per.agg(F.sum("n_flows").alias("_total"))  # one row
    return per.crossJoin(F.broadcast(total)).select("cluster_pred", "n_flows", "mean_length", (F.col("n_flows") / F.col("_total")).alias("share"))
