"""Vector sources and sinks: GeoJSON, CSV pegs, GeoPackage, summary JSON."""

from __future__ import annotations

import json
import os
import sqlite3
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landgrid.functions import crs, overlay
from landgrid.shared import scratch

# Column names looked for in a CSV of points, in order of preference.
LON, LAT = ("lon", "longitude", "x"), ("lat", "latitude", "y")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """One row a feature: the properties as columns, ``kind`` and ``coordinates`` (JSON text) of the geometry."""
    raw = spark.read.text(path, wholetext=True)
    schema = "struct<features:array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>>"
    return raw.select(F.explode(F.from_json("value", schema)["features"]).alias("f")).select(F.col("f.properties").alias("properties"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))


def rings_of(kind: Column, coordinates: Column) -> Column:
    """Coordinates text -> array of rings or lines (array<array<struct<x,y>>>); points become one ring of one vertex."""
    point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    line = lambda a: F.transform(a, point)
    read = lambda t: F.from_json(coordinates, t)
    deep = F.transform(read("array<array<array<double>>>"), line)
    flat = F.transform(F.flatten(read("array<array<array<array<double>>>>")), line)
    return F.when(kind.isin("Polygon", "MultiLineString"), deep).when(kind == "MultiPolygon", flat).when(kind.isin("LineString", "MultiPoint"), F.array(line(read("array<array<double>>")))).when(kind == "Point", F.array(F.array(point(read("array<double>")))))


def read_pegs(spark: SparkSession, path: str, target: int = 3857, compat: bool = False) -> DataFrame | None:
    """Survey points (x, y): CSV with sniffed lon/lat columns, or GeoJSON; None where the file is missing or has no such columns.

    Points are given in longitude and latitude and are brought to ``target``; ``compat`` leaves them as they are (D2).
    """
    if path.lower().endswith(".csv"):
        df = spark.read.csv(path, header=True, inferSchema=True)
        by = {c.lower(): c for c in reversed(df.columns)}
        lon, lat = (next((by[n] for n in names if n in by), None) for names in (LON, LAT))
        if lon is None or lat is None:
            return None
        df = df.select(F.col(f"`{lon}`").cast("double").alias("x"), F.col(f"`{lat}`").cast("double").alias("y"))
    else:
        df = read_geojson(spark, path).where("kind = 'Point'").select(rings_of(F.col("kind"), F.col("coordinates"))[0][0].alias("p")).select("p.x", "p.y")
    df = df.where("x IS NOT NULL AND y IS NOT NULL")
    if compat or target == 4326:
        return df
    if target not in crs.SRIDS:
        raise ValueError(f"no transformation from 4326 to {target}")
    x, y = crs.to_mercator(F.col("x"), F.col("y"))
    return df.select(x.alias("x"), y.alias("y"))


def geojson_geometry(kind: str, rings: Column) -> Column:
    """JSON text of a Polygon (rings), LineString or Point (first ring's vertices)."""
    pair = lambda p: F.array(p["x"], p["y"])
    coords = F.transform(rings, lambda r: F.transform(r, pair))
    if kind == "LineString":
        coords = coords[0]
    if kind == "Point":
        coords = coords[0][0]
    return F.to_json(F.struct(F.lit(kind).alias("type"), coords.alias("coordinates")))


def write_geojson(df: DataFrame, path: str, kind: str, rings: str = "rings", srid: int = 3857) -> None:
    """One feature a line, in longitude and latitude (GeoJSON text sequence); ``assemble`` makes one file of it."""
    ll = F.transform(F.col(rings), lambda r: crs.transform_points(r, srid, 4326))
    props = F.to_json(F.struct(*[c for c in df.columns if c != rings]))
    feature = F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":'), geojson_geometry(kind, ll), F.lit("}"))
    df.select(feature.alias("value")).write.mode("overwrite").text(path)


def assemble(spark: SparkSession, path: str, target: str) -> int:
    """Streams the feature lines into one FeatureCollection file, a partition at a time; the number of features."""
    n = 0
    with open(target, "w", encoding="utf-8") as out:
        out.write('{"type":"FeatureCollection","crs":{"type":"name","properties":{"name":"urn:ogc:def:crs:OGC:1.3:CRS84"}},"features":[\n')
        for row in spark.read.text(path).toLocalIterator():
            out.write((",\n" if n else "") + row.value)
            n += 1
        out.write("\n]}\n")
    return n


def write_layers(layers: dict[str, DataFrame], folder: str, srid: int) -> dict[str, str]:
    """A GeoPackage in the layers' CRS and a GeoJSON file a non-empty layer in degrees; the paths by name."""
    os.makedirs(folder, exist_ok=True)
    if srid not in crs.SRIDS:
        raise ValueError(f"no transformation from {srid} to 4326")
    found = {"geopackage": os.path.abspath(os.path.join(folder, "layers.gpkg"))}
    write_gpkg(layers, found["geopackage"], srid)
    for name, df in layers.items():
        target = os.path.abspath(os.path.join(folder, f"{name}.geojson"))
        found[name.replace("_", "") + "_geojson"] = target
        props = F.to_json(F.struct(*[c for c in df.columns if c != "geom"]), {"ignoreNullFields": "false"})
        lines = df.select(F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":'), overlay.call("ToGeoJson", F.col("geom"), F.lit(srid == 3857)), F.lit("}")).alias("value"))
        path = scratch(df.sparkSession, f"geojson-{name}")
        lines.write.text(path)
        if not assemble(df.sparkSession, path, target):
            os.remove(target)
    return found


def write_summary(summary: dict, path: str) -> None:
    Path(path).write_text(json.dumps(summary, indent=2), encoding="utf-8")


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


# Fixed values of the GeoPackage format: application id, header magic and flags of a geometry blob (little endian, no envelope).
_APPLICATION, _MAGIC, _FLAGS = 0x47504B47, b"GP\0", 1


def write_gpkg(layers: dict[str, DataFrame], path: str, srid: int = 3857) -> None:
    """Every non-empty layer (attribute columns, ``geom`` as WKB) as a table of one GeoPackage, in its own CRS.

    A GeoPackage is one local SQLite file; rows reach it partition by partition. Parquet is the form for large layers.
    """
    con = sqlite3.connect(path)
    con.execute(f"PRAGMA application_id={_APPLICATION}")
    con.execute("CREATE TABLE IF NOT EXISTS gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT)")
    con.execute("CREATE TABLE IF NOT EXISTS gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change TEXT NOT NULL DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ','now')), min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER)")
    con.execute("CREATE TABLE IF NOT EXISTS gpkg_geometry_columns (table_name TEXT PRIMARY KEY, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL)")
    con.execute("INSERT OR REPLACE INTO gpkg_spatial_ref_sys VALUES (?, ?, 'EPSG', ?, 'undefined', NULL)", (f"EPSG:{srid}", srid, srid))
    kinds = {"string": "TEXT", "int": "INTEGER", "bigint": "INTEGER", "double": "REAL"}
    for name, df in layers.items():
        if df is None or df.isEmpty():
            continue
        cols = [(c, kinds.get(t, "TEXT")) for c, t in df.dtypes if c != "geom"]
        con.execute(f'DROP TABLE IF EXISTS "{name}"')
        con.execute(f'CREATE TABLE "{name}" (fid INTEGER PRIMARY KEY AUTOINCREMENT, geom BLOB, ' + ", ".join(f'"{c}" {t}' for c, t in cols) + ")")
        head = _MAGIC + bytes([_FLAGS]) + srid.to_bytes(4, "little", signed=True)
        rows = ((head + bytes(r["geom"]), *[r[c] for c, _ in cols]) for r in df.toLocalIterator())
        con.executemany(f'INSERT INTO "{name}" (geom, ' + ", ".join(f'"{c}"' for c, _ in cols) + ") VALUES (" + ", ".join("?" * (len(cols) + 1)) + ")", rows)
        con.execute("INSERT OR REPLACE INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES (?, 'features', ?, ?)", (name, name, srid))
        con.execute("INSERT OR REPLACE INTO gpkg_geometry_columns VALUES (?, 'geom', 'GEOMETRY', ?, 0, 0)", (name, srid))
    con.commit()
    con.close()


def read_gpkg(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """One layer: attribute columns and ``geom`` as WKB."""
    con = sqlite3.connect(path)
    cols = [(r[1], r[2]) for r in con.execute(f'PRAGMA table_info("{layer}")') if r[1] != "fid"]
    if not cols:
        raise ValueError(f"{path} has no layer {layer}")
    kinds = {"TEXT": "string", "INTEGER": "bigint", "REAL": "double", "BLOB": "binary"}
    rows = [tuple(bytes(v[8:]) if c == "geom" else v for (c, _), v in zip(cols, r)) for r in con.execute("SELECT " + ", ".join(f'"{c}"' for c, _ in cols) + f' FROM "{layer}"')]
    con.close()
    return spark.createDataFrame(rows, ", ".join(f"`{c}` {kinds.get(t, 'string')}" for c, t in cols))
