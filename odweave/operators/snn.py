"""Clustering by shared-nearest-neighbour density."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.skew import attach, ordered_index
from ..plans.storage import materialize
from .components import CHUNK, connected_components
from .knn import nearest


def _shared(knn: DataFrame) -> DataFrame:
    """(from, to, rank, shared): how many neighbours a point and each of its neighbours have in common."""
    lists = knn.groupBy("ref").agg(F.collect_list("nn").alias("near"))
    own = knn.join(lists, "ref").select(F.col("ref").alias("from"), F.col("nn").alias("to"), "rank", F.col("near").alias("_a"))
    other = lists.select(F.col("ref").alias("to"), F.col("near").alias("_b"))
    return own.join(other, "to", "left").select("from", "to", "rank", F.size(F.array_intersect("_a", F.coalesce("_b", F.array().cast("array<long>")))).alias("shared"))


def reachable_edges(knn: DataFrame, eps: int) -> DataFrame:
    """(from, to, rank) of neighbours that share at least eps neighbours: directly reachable."""
    return _shared(knn).filter(F.col("shared") >= eps).select("from", "to", "rank")


def density(knn: DataFrame, ids: DataFrame, key: str, eps: int) -> DataFrame:
    """(flow, shared_density): how many neighbours are directly reachable."""
    n = reachable_edges(knn, eps).groupBy("from").agg(F.count("*").alias("n"))
    return ids.select(F.col(key).alias("flow")).join(n, F.col("flow") == F.col("from"), "left").select("flow", F.coalesce("n", F.lit(0)).cast("int").alias("shared_density"))


def core_components(edges: DataFrame, cores: DataFrame) -> DataFrame:
    """(flow, label): components of cores that reach each other either way, numbered from 1 by the smallest core with an edge to another."""
    c = cores.select("flow")
    between = edges.join(c.withColumnRenamed("flow", "from"), "from", "left_semi").join(c.withColumnRenamed("flow", "to"), "to", "left_semi")
    between = materialize(between.select("from", "to"), "snn-core")
    parts = connected_components(between, "from", "to", "snn-components", CHUNK)
    first = between.join(parts, F.col("from") == F.col("node")).groupBy("component").agg(F.min("from").alias("first"))
    # One row for each cluster.
    number = ordered_index(first, [F.col("first")], "_i", "snn-numbers").select("component", (F.col("_i") + 1).cast("int").alias("label"))
    return parts.join(number, "component").select(F.col("node").alias("flow"), "label")


def snn_clusters(pairs: DataFrame, ids: DataFrame, key: str, k: int, eps: int, minpts: int, whole: bool = True) -> DataFrame:
    """M4 (whole distances) and M5 (doubles): (id, cluster_pred), 0 for noise, one row for each id.

    Cores have a density of at least minpts. A core keeps its component's number if some core reaches it.
    Another point that a core reaches takes the number of its nearest neighbour that has one; numbers aren't
    passed on. Everything else is noise, also where no two cores are adjacent.
    """
    knn = materialize(nearest(pairs, k, whole), "snn-knn")
    return snn_from_knn(knn, ids, key, eps, minpts)


def snn_from_knn(knn: DataFrame, ids: DataFrame, key: str, eps: int, minpts: int) -> DataFrame:
    edges = materialize(reachable_edges(knn, eps), "snn-edges")
    cores = edges.groupBy(F.col("from").alias("flow")).agg(F.count("*").alias("n")).filter(F.col("n") >= minpts).select("flow")
    if minpts <= 0:
        cores = ids.select(F.col(key).alias("flow"))
    labels = materialize(core_components(edges, cores), "snn-labels")
    reached = edges.join(cores.withColumnRenamed("flow", "from"), "from", "left_semi").select(F.col("to").alias("id")).distinct()
    state = ids.select(F.col(key).alias("id")).join(labels.withColumnRenamed("flow", "id"), "id", "left").join(reached.withColumn("reached", F.lit(True)), "id", "left")
    near = knn.join(labels.select(F.col("flow").alias("nn"), F.col("label").alias("near_label")), "nn")
    donor = near.groupBy(F.col("ref").alias("id")).agg(F.min_by("near_label", "rank").alias("given"))
    own = F.when(F.col("reached"), F.coalesce("label", "given")).otherwise(F.lit(0))
    return state.join(donor, "id", "left").select("id", F.coalesce(own, F.lit(0)).cast("int").alias("cluster_pred"))


def custom_parameters(k: int) -> tuple[int, int]:
    """M9: (eps, minpts) of k: minpts is half of k (half-even), eps one more."""
    minpts = round(k / 2)
    return minpts + 1, minpts


def snn_custom(knn: DataFrame, ids: DataFrame, key: str, k: int) -> DataFrame:
    """M9: snn clusters with the parameters that follow from k."""
    eps, minpts = custom_parameters(k)
    return snn_from_knn(knn.filter(F.col("rank") <= k), ids, key, eps, minpts)


#: Points that share a neighbour and meet in one group at most, on either side.
HUB = 2048


def similarity(knn: DataFrame, hub: int = HUB) -> DataFrame:
    """(i, j, similarity) for i < j: how many neighbours two points share, of pairs that share any; the product of the neighbour matrix with itself.

    Points meet by the neighbours they share. Those of a hub, a neighbour of more than `hub` points, are dealt into parts
    that meet two by two, so no group makes more than hub * hub pairs whatever the hub's size; all its pairs are rows of the
    result by definition.
    """
    counts = knn.groupBy("nn").agg(F.count("*").alias("n")).withColumn("_parts", F.ceil(F.col("n") / hub).cast("int"))
    rows = attach(knn.select("ref", "nn"), counts, "nn", "n", F.xxhash64("ref")).withColumn("_own", F.pmod(F.xxhash64("ref"), F.col("_parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    a = rows.select(F.col("ref").alias("i"), "nn", F.col("_own").alias("_a"), every.alias("_b"))
    b = rows.select(F.col("ref").alias("j"), "nn", F.col("_own").alias("_b"), every.alias("_a"))
    return a.join(b, ["nn", "_a", "_b"]).filter("i < j").groupBy("i", "j").agg(F.count("*").alias("similarity"))


def jarvis_patrick(knn: DataFrame, ids: DataFrame, key: str, eps: int, minpts: int) -> DataFrame:
    """Shared-neighbour graph (points in each other's lists, each counted as its own neighbour) cut at eps, then density clusters with border points."""
    own = knn.unionByName(ids.select(F.col(key).alias("ref"), F.col(key).alias("nn"), F.lit(0).cast(dict(knn.dtypes)["distance"]).alias("distance"), F.lit(0).alias("rank")))
    s = _shared(own).filter("from <> to")
    mutual = s.join(s.select(F.col("to").alias("from"), F.col("from").alias("to")), ["from", "to"]).filter(F.col("shared") >= eps).select("from", "to")
    return density_clusters(materialize(mutual, "snn-mutual"), ids, key, minpts)


def density_clusters(near: DataFrame, ids: DataFrame, key: str, minpts: int) -> DataFrame:
    """(id, cluster_pred) from near(from, to), both ways: cores have minpts points near, themselves included; a border point takes the
    number of its smallest near core; clusters are numbered by their smallest core."""
    n = near.groupBy(F.col("from").alias("id")).agg(F.count("*").alias("n"))
    all_ids = ids.select(F.col(key).alias("id"))
    cores = materialize(all_ids.join(n, "id", "left").filter(F.coalesce("n", F.lit(0)) + 1 >= minpts).select("id"), "density-cores")
    c = cores.withColumnRenamed("id", "from")
    loops = c.select("from", F.col("from").alias("to"))
    between = near.join(c, "from", "left_semi").join(cores.withColumnRenamed("id", "to"), "to", "left_semi").select("from", "to").unionByName(loops)
    parts = connected_components(between, "from", "to", "density-components", CHUNK)
    number = ordered_index(parts.select("component").distinct(), [F.col("component")], "_i", "density-numbers").select("component", (F.col("_i") + 1).cast("int").alias("label"))
    labels = materialize(parts.join(number, "component").select(F.col("node").alias("id"), "label"), "density-labels")
    border = near.join(labels.withColumnsRenamed({"id": "to", "label": "given"}), "to").groupBy(F.col("from").alias("id")).agg(F.min_by("given", "to").alias("given"))
    out = all_ids.join(labels, "id", "left").join(border, "id", "left")
    return out.select("id", F.coalesce("label", "given", F.lit(0)).cast("int").alias("cluster_pred"))
