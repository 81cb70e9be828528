"""Cluster validity and parameter sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .distance import symmetric


def silhouette(pairs: DataFrame, labels: DataFrame, drop_noise: bool = True) -> DataFrame:
    """V1: (id, cluster, sil) from pairs(i, j, d) and labels(id, cluster). A cluster of one point has 0; no rows for fewer than two clusters."""
    l = labels.filter("cluster <> 0") if drop_noise else labels
    size = l.groupBy("cluster").agg(F.count("*").alias("n"))
    d = symmetric(pairs).join(l.select(F.col("id").alias("i"), F.col("cluster").alias("ci")), "i").join(l.select(F.col("id").alias("j"), F.col("cluster").alias("cj")), "j")
    per = d.groupBy("i", "ci", "cj").agg(F.avg("d").alias("m"))
    ab = per.groupBy("i", "ci").agg(F.max(F.when(F.col("ci") == F.col("cj"), F.col("m"))).alias("a"), F.min(F.when(F.col("ci") != F.col("cj"), F.col("m"))).alias("b"))
    s = ab.join(size, F.col("ci") == F.col("cluster")).filter("b IS NOT NULL")
    sil = F.when(F.col("n") == 1, F.lit(0.0)).when(F.greatest("a", "b") == 0, F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return s.select(F.col("i").alias("id"), "cluster", sil.alias("sil"))


def silhouette_means(sil: DataFrame) -> DataFrame:
    """(cluster, mean_sil)."""
    return sil.groupBy("cluster").agg(F.avg("sil").alias("mean_sil"))


def _pairs_of(n):  # noqa: ANN001, ANN202
    return n * (n - 1) / 2


def contingency(labels: DataFrame, a: str, b: str) -> DataFrame:
    return labels.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))


def index_columns() -> list[Column]:
    """The indices by total, tp, hc, pr, hr, pc, hp and top: sums over cells, rows and columns of a contingency table."""
    c = F.col
    allp = _pairs_of(c("total"))
    fp, fn = c("pc") - c("tp"), c("pr") - c("tp")
    tn = allp - c("tp") - fp - fn
    expected, most = c("pr") * c("pc") / F.nullif(allp, F.lit(0.0)), (c("pr") + c("pc")) / 2
    h = lambda s: F.log(c("total")) - s / c("total")
    h_t, h_p, h_tp = h(c("hr")), h(c("hp")), h(c("hc"))
    mutual = h_t + h_p - h_tp
    safe = lambda a, b: a / F.nullif(b, F.lit(0.0))
    return [
        safe(c("tp") + tn, allp).alias("rand"), F.coalesce(safe(c("tp") - expected, most - expected), F.lit(1.0)).alias("ari"), safe(c("tp"), c("tp") + fp + fn).alias("jaccard"),
        safe(c("tp"), F.sqrt(c("pr") * c("pc"))).alias("fowlkes_mallows"), (2 * (fp + fn)).alias("mirkin"), safe(c("top"), c("total")).alias("purity"),
        safe(h_tp - h_p, h_t).alias("entropy"), safe(mutual, F.sqrt(h_t * h_p)).alias("nmi"), safe(2 * h_tp - h_t - h_p, h_tp).alias("nvi"),
        safe(allp * c("tp") - c("pr") * c("pc"), F.sqrt(c("pr") * c("pc") * (allp - c("pr")) * (allp - c("pc")))).alias("hubert"),
    ]


def external_indices(labels: DataFrame, truth: str, pred: str) -> DataFrame:
    """V3-V5: one row of indices from the contingency table of two labellings. ARI is 1 where both are trivial."""
    t = contingency(labels, truth, pred)
    rows, cols = t.groupBy(truth).agg(F.sum("n").alias("n"), F.max("n").alias("top")), t.groupBy(pred).agg(F.sum("n").alias("n"), F.max("n").alias("top"))
    xlogx = lambda c: F.sum(c * F.log(c))
    cell = t.agg(F.sum("n").alias("total"), F.sum(_pairs_of(F.col("n"))).alias("tp"), xlogx(F.col("n")).alias("hc"))
    row = rows.agg(F.sum(_pairs_of(F.col("n"))).alias("pr"), xlogx(F.col("n")).alias("hr"))
    col = cols.agg(F.sum(_pairs_of(F.col("n"))).alias("pc"), xlogx(F.col("n")).alias("hp"), F.sum("top").alias("top"))
    return cell.crossJoin(row).crossJoin(col).select(*index_columns())  # single rows


def adjusted_rand(labels: DataFrame, truth: str, pred: str) -> DataFrame:
    """V3: (ari)."""
    return external_indices(labels, truth, pred).select("ari")


def internal_indices(points: DataFrame, columns: list[str], cluster: str, pairs: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    """V6: calinski_harabasz, davies_bouldin, dunn, xie_beni of points(id, columns, cluster) and their pair distances, or `ends` of these as blocks.cluster_ends() gives them; noise (0) is left out."""
    p = points.filter(F.col(cluster) != 0).select("id", F.col(cluster).alias("c"), *[F.col(x).cast("double").alias(x) for x in columns])
    mean = p.groupBy("c").agg(F.count("*").alias("n"), *[F.avg(x).alias(f"m_{x}") for x in columns])
    grand = p.agg(F.count("*").alias("total"), F.countDistinct("c").alias("k"), *[F.avg(x).alias(f"g_{x}") for x in columns])
    sq = lambda a, b: sum(((F.col(f"{a}{x}") - F.col(f"{b}{x}")) * (F.col(f"{a}{x}") - F.col(f"{b}{x}")) for x in columns), F.lit(0.0))
    own = p.join(mean, "c")
    within = own.groupBy("c").agg(F.sum(sq("", "m_")).alias("ss"), F.avg(F.sqrt(sq("", "m_"))).alias("spread"))
    between = mean.crossJoin(F.broadcast(grand)).agg(F.sum(F.col("n") * sq("m_", "g_")).alias("b"), F.first("total").alias("total"), F.first("k").alias("k"))
    both = mean.join(within, "c")
    o = both.select(F.col("c").alias("c2"), F.col("spread").alias("spread2"), *[F.col(f"m_{x}").alias(f"o_{x}") for x in columns])
    # Pairs of clusters, not of points.
    cc = both.join(o, F.col("c") != F.col("c2")).withColumn("far", F.sqrt(sq("m_", "o_")))
    db = cc.groupBy("c").agg(F.max((F.col("spread") + F.col("spread2")) / F.nullif("far", F.lit(0.0))).alias("r")).agg(F.avg("r").alias("db"))
    near = cc.agg(F.min("far").alias("near"))
    w = within.agg(F.sum("ss").alias("w"))
    if ends is None:
        l = p.select("id", "c")
        d = pairs.join(l.withColumnsRenamed({"id": "i", "c": "ci"}), "i").join(l.withColumnsRenamed({"id": "j", "c": "cj"}), "j")
        ends = d.agg(F.min(F.when(F.col("ci") != F.col("cj"), F.col("d"))).alias("sep"), F.max(F.when(F.col("ci") == F.col("cj"), F.col("d"))).alias("diam"))
    one = between.crossJoin(db).crossJoin(near).crossJoin(w).crossJoin(ends)  # single rows
    c = F.col
    return one.select(
        ((c("b") / (c("k") - 1)) / (c("w") / (c("total") - c("k")))).alias("calinski_harabasz"), c("db").alias("davies_bouldin"),
        (c("sep") / c("diam")).cast("double").alias("dunn"), (c("w") / (c("total") * c("near") * c("near"))).alias("xie_beni"),
    )


def cluster_counts(labels: DataFrame) -> DataFrame:
    """n_cluster without noise, n_cluster_all with it, n_noise and mean_size."""
    n = labels.groupBy("cluster").agg(F.count("*").alias("n"))
    is_noise = F.col("cluster") == 0
    return n.agg(F.count(F.when(~is_noise, 1)).alias("n_cluster"), F.count("*").alias("n_cluster_all"), F.coalesce(F.sum(F.when(is_noise, F.col("n"))), F.lit(0)).alias("n_noise"), F.avg(F.when(~is_noise, F.col("n"))).alias("mean_size"))


def parameter_grid(spark, ks: list[int], epss: list[int], minptss: list[int]) -> DataFrame:  # noqa: ANN001
    """(k, eps, minpts) with eps and minpts below k."""
    one = lambda name, xs: spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in xs])).alias(name))
    return one("k", ks).crossJoin(one("eps", epss)).crossJoin(one("minpts", minptss)).filter("eps < k AND minpts < k")


def batch_labels(knn: DataFrame, ids: DataFrame, key: str, ks: list[int]) -> DataFrame:
    """E5: (k, id, cluster_pred) of snn clusters for several k, with the parameters that follow from each. Neighbours are found once, for the largest k."""
    from .snn import snn_custom

    out = None
    for k in ks:
        rows = snn_custom(knn, ids, key, k).select(F.lit(k).alias("k"), "id", "cluster_pred")
        out = rows if out is None else out.unionByName(rows)
    return out


def silhouette_curve(points: DataFrame, key: str, columns: list[str], labels: DataFrame) -> DataFrame:
    """(k, mean_sil, n_cluster) by batch_labels() rows of points(key, columns): the mean over clusters of the mean silhouette; noise is left out. k without clusters that can be compared gives no row."""
    from .blocks import silhouette as silhouette_of

    out = None
    for (k,) in sorted(labels.select("k").distinct().collect()):  # one row for each run
        own = points.join(labels.filter((F.col("k") == k) & (F.col("cluster_pred") > 0)).select(F.col("id").alias(key), F.col("cluster_pred").alias("cluster")), key)
        means = silhouette_means(silhouette_of(own, key, columns, "cluster"))
        row = means.agg(F.avg("mean_sil").alias("mean_sil"), F.count("*").alias("n_cluster")).filter("n_cluster > 0").select(F.lit(k).alias("k"), "mean_sil", "n_cluster")
        out = row if out is None else out.unionByName(row)
    return out


def density_histogram(pairs: DataFrame, bins: int = 20) -> DataFrame:
    """V9: (bin, n) of distances scaled to [0, 1], each pair once."""
    from .distance import rescaled

    x = rescaled(pairs.select(F.col("d").cast("double").alias("d")), ["d"])
    return x.groupBy(F.least(F.floor(F.col("d") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
