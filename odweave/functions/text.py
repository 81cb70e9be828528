"""Geometry as text: WKT and GeoJSON parsed and written as Column expressions. Text that is malformed, or of another type, gives null.

Points are struct(x, y), lines arrays of points, polygons arrays of rings, the outer one first. Further ordinates
(z, m) are not accepted in WKT and left out in GeoJSON. An empty geometry is an empty array; an empty point is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
_POINT = rf"^\s*({_NUMBER})\s+({_NUMBER})\s*$"


def _body(text: Column, name: str) -> Column:
    """What stands between the outermost parentheses of this type's text (an optional SRID before it), '' if it is empty, else null."""
    head = rf"(?is)^\s*(?:SRID=[0-9]+;)?\s*{name}\s*"
    inner = F.regexp_extract(text, rf"{head}\((.*)\)\s*$", 1)
    return F.when(text.rlike(rf"{head}EMPTY\s*$"), F.lit("")).when(text.rlike(rf"{head}\(.*\)\s*$") & (F.trim(inner) != ""), inner)


def _points(text: Column) -> Column:
    """Points between commas; null if one is malformed."""
    parts = F.split(text, ",", -1)
    point = lambda p: F.struct(F.regexp_extract(p, _POINT, 1).cast("double").alias("x"), F.regexp_extract(p, _POINT, 2).cast("double").alias("y"))
    return F.when(F.forall(parts, lambda p: p.rlike(_POINT)), F.transform(parts, point))


def point_from_wkt(text: Column) -> Column:
    points = _points(_body(text, "POINT"))
    return F.when(F.size(points) == 1, F.get(points, F.lit(0)))


def line_from_wkt(text: Column) -> Column:
    body = _body(text, "LINESTRING")
    points = _points(body)
    return F.when(body == "", F.array().cast("array<struct<x:double,y:double>>")).when(F.size(points) > 1, points)


def polygon_from_wkt(text: Column) -> Column:
    """Rings have four points at least and end where they begin."""
    body = _body(text, "POLYGON")
    inner = F.regexp_extract(body, r"(?s)^\s*\((.*)\)\s*$", 1)
    rings = F.transform(F.split(inner, r"\)\s*,\s*\(", -1), _points)
    closed = lambda r: F.coalesce((F.size(r) > 3) & (F.get(r, F.lit(0)) == F.get(r, F.size(r) - 1)), F.lit(False))
    return F.when(body == "", F.array().cast("array<array<struct<x:double,y:double>>>")).when((inner != "") & F.forall(rings, closed), rings)


def _plain(x: Column) -> Column:
    """The shortest digits of a double, without an exponent where its size is 1e-4 to under 1e16 (or 0)."""
    text, size = x.cast("string"), F.abs(x)
    decimal = F.when(size >= 1, text.cast("decimal(28,10)").cast("string")).otherwise(text.cast("decimal(38,24)").cast("string"))
    return F.when(text.contains("E") & (size >= 1e-4) & (size < 1e16), F.regexp_replace(decimal, r"(\.[0-9]+?)0+$", "$1")).otherwise(text)


def _listed(points: Column) -> Column:
    return F.array_join(F.transform(points, lambda p: F.concat(_plain(p["x"]), F.lit(" "), _plain(p["y"]))), ", ")


def point_to_wkt(point: Column) -> Column:
    return F.concat(F.lit("POINT ("), _plain(point["x"]), F.lit(" "), _plain(point["y"]), F.lit(")"))


def line_to_wkt(line: Column) -> Column:
    return F.when(F.size(line) == 0, F.lit("LINESTRING EMPTY")).when(F.size(line) > 0, F.concat(F.lit("LINESTRING ("), _listed(line), F.lit(")")))


def polygon_to_wkt(rings: Column) -> Column:
    text = F.array_join(F.transform(rings, lambda r: F.concat(F.lit("("), _listed(r), F.lit(")"))), ", ")
    return F.when(F.size(rings) == 0, F.lit("POLYGON EMPTY")).when(F.size(rings) > 0, F.concat(F.lit("POLYGON ("), text, F.lit(")")))


def _coordinates(text: Column, name: str, kind: str) -> Column:
    got = F.from_json(text, f"type string, coordinates {kind}")
    return F.when(got["type"] == name, got["coordinates"])


def _pair(c: Column) -> Column:
    return F.struct(F.get(c, F.lit(0)).alias("x"), F.get(c, F.lit(1)).alias("y"))


def _sound(points: Column) -> Column:
    return F.coalesce(F.forall(points, lambda c: (F.size(c) > 1) & F.get(c, F.lit(0)).isNotNull() & F.get(c, F.lit(1)).isNotNull()), F.lit(False))


def point_from_geojson(text: Column) -> Column:
    c = _coordinates(text, "Point", "array<double>")
    return F.when(_sound(F.array(c)), _pair(c))


def line_from_geojson(text: Column) -> Column:
    c = _coordinates(text, "LineString", "array<array<double>>")
    return F.when(_sound(c) & (F.size(c) != 1), F.transform(c, _pair))


def polygon_from_geojson(text: Column) -> Column:
    c = _coordinates(text, "Polygon", "array<array<array<double>>>")
    closed = lambda r: F.coalesce(_sound(r) & (F.size(r) > 3) & (F.get(r, F.lit(0)) == F.get(r, F.size(r) - 1)), F.lit(False))
    return F.when(F.forall(c, closed), F.transform(c, lambda r: F.transform(r, _pair)))


def _arrays(points: Column) -> Column:
    return F.transform(points, lambda p: F.array(p["x"], p["y"]))


def _geojson(name: str, of: Column, coordinates: Column) -> Column:
    return F.when(of.isNotNull(), F.to_json(F.struct(F.lit(name).alias("type"), coordinates.alias("coordinates"))))


def point_to_geojson(point: Column) -> Column:
    return _geojson("Point", point, F.array(point["x"], point["y"]))


def line_to_geojson(line: Column) -> Column:
    return _geojson("LineString", line, _arrays(line))


def polygon_to_geojson(rings: Column) -> Column:
    return _geojson("Polygon", rings, F.transform(rings, _arrays))
