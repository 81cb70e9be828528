"""Scratch tables in the folder that driver and executors share.

Long or iterative plans are cut by writing a table and reading it again: the rows survive the loss of
any executor, keep their columnar form and are computed once.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset, a temporary folder, on a single machine only."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/odweave-{spark.sparkContext.applicationId}"
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="odweave-")
        atexit.register(shutil.rmtree, _LOCAL[app], True)
    return f"file://{_LOCAL[app]}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the scratch root that nothing has used yet."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes the rows as Parquet and returns them as read back; the plan's lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Deletes scratch tables that no later plan reads. Others' DataFrames are left alone."""
    for t in tables:
        path = getattr(t, "_scratch", None)
        if path:
            jvm = t.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def parallelism(spark: SparkSession, per_core: int = 2) -> int:
    """Partitions for a step whose work per byte is high: several for each core, and no fewer than the session shuffles to."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), per_core * spark.sparkContext.defaultParallelism)
