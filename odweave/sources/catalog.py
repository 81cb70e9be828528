"""Namespaces and tables, found by name patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def namespace(data: str, min_length: int, week: int, weekdays: str, months: int, cutoff: int) -> str:
    """The name of an experiment's namespace, which holds its parameters."""
    return f"{data}_min{min_length}m_kw{week}_wdays{weekdays}_{months}m_buffer{cutoff}m"


def create_namespace(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")


def _like(name: str, pattern: str) -> bool:
    import re

    return re.fullmatch(".*".join(map(re.escape, pattern.split("%"))), name) is not None


def tables(spark: SparkSession, like: list[str] | None = None, unlike: list[str] | None = None, schema: str = "default") -> list[str]:
    """Names of a namespace's tables that match all of `like` and none of `unlike`, in order."""
    names = sorted(t.name for t in spark.catalog.listTables(schema) if not t.isTemporary)
    return [n for n in names if all(_like(n, p) for p in like or []) and not any(_like(n, p) for p in unlike or [])]


def networks(spark: SparkSession, schema: str = "default") -> list[str]:
    return tables(spark, ["%2po_4pgr%"], ["%dist%", "%convex_hull%"], schema)


def raw_trip_tables(spark: SparkSession, schema: str = "default") -> list[str]:
    return tables(spark, None, ["%cluster%", "%2po_4pgr%", "%mapped%"], schema)


def mapped_trip_tables(spark: SparkSession, schema: str = "default") -> list[str]:
    return tables(spark, ["%mapped"], None, schema)


def namespaces(spark: SparkSession) -> list[str]:
    return sorted(d.name for d in spark.catalog.listDatabases() if d.name != "information_schema" and not d.name.startswith(("pg_toast", "pg_temp")))


def tables_in(spark: SparkSession, schema: str) -> list[str]:
    return tables(spark, None, ["%convex%"], schema)


def point_cluster_tables(spark: SparkSession, schema: str) -> list[str]:
    return tables(spark, ["%cl2%"], None, schema)


def network_cluster_tables(spark: SparkSession, schema: str) -> list[str]:
    return tables(spark, ["%cl3%"], None, schema)


def geometry_column(df: DataFrame) -> tuple[str, str] | None:
    """The first column that is a point (struct of x, y) or a line (array of points), with its kind."""
    for name, kind in df.dtypes:
        plain = kind.replace("int", "double").replace("bigdouble", "double")
        if plain == "struct<x:double,y:double>":
            return name, "POINT"
        if plain == "array<struct<x:double,y:double>>":
            return name, "LINESTRING"
    return None


def with_srid(df: DataFrame, column: str, srid: int) -> DataFrame:
    """The column with a reference system in its metadata."""
    return df.withMetadata(column, {**df.schema[column].metadata, "srid": srid})


def srid_of(df: DataFrame, column: str) -> int | None:
    return df.schema[column].metadata.get("srid")
