"""Overlay functions on WKB, run in the JVM by the JTS library that ships with Spark.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landgrid.functions import jvm

_WKB = T.BinaryType()
_LIST = T.ArrayType(T.BinaryType())
FUNCTIONS = {
    "FromText": _WKB, "ToText": T.StringType(), "Area": T.DoubleType(), "Length": T.DoubleType(), "Kind": T.StringType(),
    "IsValid": T.BooleanType(), "IsEmpty": T.BooleanType(), "MakeValid": _WKB, "LargestPart": _WKB, "Polygons": _LIST,
    "Centroid": _WKB, "Envelope": T.ArrayType(T.DoubleType()), "MinimumRectangle": _WKB, "Simplify": _WKB, "Buffer": _WKB, "Corridor": _WKB, "UnionAll": _WKB,
    "Difference": _WKB, "Intersection": _WKB, "BoxAreas": T.ArrayType(T.DoubleType()), "Intersects": T.BooleanType(), "Contains": T.BooleanType(),
    "VoronoiCells": _LIST, "Snap": _WKB, "PlanarFold": _LIST, "PlanarTurns": _LIST, "PointAlong": T.ArrayType(T.DoubleType()), "ToGeoJson": T.StringType(),
}
_SOURCE = Path(__file__).parent / "java" / "Overlay.java"


def install(spark: SparkSession) -> None:
    """Registers ``lg_<name>`` for every function, once a session."""
    jvm.register(spark, _SOURCE, {f"lg_{name.lower()}": (f"landgrid.Overlay${name}", kind) for name, kind in FUNCTIONS.items()})


def call(name: str, *args: Column | str | float) -> Column:
    """``call("Difference", "a", "b")``: strings are columns, numbers literals."""
    cols = [F.lit(float(x)) if isinstance(x, (int, float)) else F.col(x) if isinstance(x, str) else x for x in args]
    return F.call_function(f"lg_{name.lower()}", *cols)
