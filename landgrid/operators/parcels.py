"""Parcel tessellation (section 2.M): road corridors, super-blocks, Voronoi lots, lot splitting, snapping, building counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landgrid.functions import overlay
from landgrid.operators import joins, topology

LARGE, LONG = 4000.0, 60.0
CONFIDENCE = 0.90  # fixed value of this layer


def large_lot(area, dx, dy):
    """H-10."""
    return (area > LARGE) & (dx > dy) & (dx > LONG)


def split_box_lots(boxes: DataFrame, min_area: float) -> DataFrame:
    """M-6 on boxes: large wide ones give two halves, lots under the least area are dropped. Adds lot, area."""
    dx, dy = F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")
    mid = (F.col("minx") + F.col("maxx")) / 2
    lot = lambda n, a, b: F.struct(F.lit(n).alias("lot"), a.alias("minx"), b.alias("maxx"))
    halves = F.when(large_lot(dx * dy, dx, dy), F.array(lot(1, F.col("minx"), mid), lot(2, mid, F.col("maxx")))).otherwise(F.array(lot(1, F.col("minx"), F.col("maxx"))))
    out = boxes.select("id", "miny", "maxy", F.explode(halves).alias("h")).select("id", "h.*", "miny", "maxy")
    return out.withColumn("area", (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))).where(F.col("area") >= min_area)


def union_all(df: DataFrame, column: str = "geom", fan: int = 64) -> DataFrame:
    """F16, I8: union aggregate in two steps, so that no group holds all geometries. One row."""
    part = df.groupBy(F.pmod(F.xxhash64(column), F.lit(fan)).alias("k")).agg(overlay.call("UnionAll", F.collect_list(column)).alias("u"))
    return part.agg(overlay.call("UnionAll", F.collect_list("u")).alias("u"))


def super_blocks(extent_wkt: str, roads: DataFrame) -> DataFrame:
    """M-2, M-3: extent minus the union of road corridors, as single polygons: block_id, geom."""
    spark = roads.sparkSession
    overlay.install(spark)
    width = F.coalesce("width_m", F.lit(4.0))
    corridors = roads.where(F.col("geom").isNotNull()).where(overlay.call("IsValid", "geom") & ~overlay.call("IsEmpty", "geom"))
    corridors = corridors.select(overlay.call("Corridor", "geom", F.greatest(F.lit(1.5), width / 2)).alias("geom"))
    left = union_all(corridors).select(overlay.call("Difference", overlay.call("FromText", F.lit(extent_wkt)), F.col("u")).alias("g"))
    return left.select(F.posexplode(overlay.call("Polygons", "g")).alias("block_id", "geom"))


def _inside(points: DataFrame, polygons: DataFrame, cell: float, test: str) -> DataFrame:
    """Equi-join on grid cells and box test, then the exact predicate."""
    near = joins.points_in_boxes(points, topology.boxed(polygons), cell, strict=False)
    return near.where(overlay.call(test, "geom", "point"))


def delineate(extent_wkt: str, roads: DataFrame, buildings: DataFrame, pegs: DataFrame | None = None, min_area: float = 80.0, tolerance: float = 2.0, cell: float = 50.0) -> DataFrame:
    """M-1: id, class, confidence, area_sqm, perimeter_m, length_m, width_m, buildings_count, geom.

    roads (geom, width_m), buildings (geom) and pegs (x, y) share one projected CRS; pegs are reprojected by their source.
    Blocks with two or more building centres become Voronoi lots, the others are split once if large. Ids follow position.
    """
    blocks = super_blocks(extent_wkt, roads).where(overlay.call("Area", "geom") >= min_area)
    centre = overlay.call("Centroid", "geom")
    seeds = buildings.where(F.col("geom").isNotNull()).where(overlay.call("IsValid", "geom")).select(centre.alias("point"))
    xy = F.split(F.regexp_replace(overlay.call("ToText", "point"), r"[A-Z()]+", ""), " ")
    at = lambda k: F.element_at(F.filter(xy, lambda v: v != ""), k).try_cast("double")
    seeds = seeds.select("point", at(1).alias("x"), at(2).alias("y")).where("x IS NOT NULL")
    held = _inside(seeds, blocks, cell, "Contains").groupBy("block_id").agg(F.array_sort(F.collect_list("point")).alias("seeds"))
    blocks = blocks.join(held, "block_id", "left")
    several = F.coalesce(F.size("seeds"), F.lit(0)) > 1
    cells = blocks.where(several).select(F.explode(overlay.call("VoronoiCells", "seeds", "geom", 10.0)).alias("geom"))
    single = topology.boxed(blocks.where(~several).select("geom"))
    dx, dy = F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")
    mid = (F.col("minx") + F.col("maxx")) / 2
    box = lambda a, b: overlay.call("FromText", F.format_string("POLYGON ((%1$s %3$s, %2$s %3$s, %2$s %4$s, %1$s %4$s, %1$s %3$s))", a.cast("string"), b.cast("string"), F.col("miny").cast("string"), F.col("maxy").cast("string")))
    halves = F.array(overlay.call("Intersection", F.col("geom"), box(F.col("minx"), mid)), overlay.call("Intersection", F.col("geom"), box(mid, F.col("maxx"))))
    big = large_lot(overlay.call("Area", "geom"), dx, dy)
    lots = single.select(F.explode(F.when(big, F.filter(halves, lambda g: overlay.call("Kind", g) == "Polygon")).otherwise(F.array("geom"))).alias("geom"))
    rows = joins.union_all([cells, lots]).where(overlay.call("Area", "geom") >= min_area)
    if pegs is not None:
        # pegs near a parcel only: a peg joins the parcels whose box, grown by the tolerance, holds it
        rows = topology.boxed(rows).withColumn("key", F.xxhash64("geom"))
        grown = rows.select("key", *[(F.col(s) + d * tolerance).alias(s) for s, d in (("minx", -1), ("miny", -1), ("maxx", 1), ("maxy", 1))])
        coords = F.array_sort(F.collect_set(F.concat_ws(" ", F.col("x").cast("string"), F.col("y").cast("string"))))
        near = joins.points_in_boxes(pegs.select("x", "y"), grown, cell, strict=False).groupBy("key").agg(F.concat(F.lit("MULTIPOINT ("), F.array_join(coords, ", "), F.lit(")")).alias("pegs"))
        rows = rows.join(near, "key", "left").withColumn("geom", F.coalesce(overlay.call("Snap", F.col("geom"), overlay.call("FromText", "pegs"), tolerance), F.col("geom"))).select("geom")
    rows = rows.withColumn("geom", overlay.call("LargestPart", overlay.call("MakeValid", "geom"))).where("geom IS NOT NULL")
    rows = topology.boxed(topology.with_dimensions(topology.measured(rows))).where(F.col("area_sqm") >= min_area).withColumn("key", F.xxhash64("geom"))
    count = _inside(seeds, rows.select("key", "geom"), cell, "Intersects").groupBy("key").agg(F.count("*").cast("int").alias("n"))
    rows = rows.join(count, "key", "left")
    from landgrid.functions.text import numbered

    rows = numbered(rows, "PRCL_", ["minx", "miny", "maxx", "maxy", "key"])
    return rows.select("id", F.lit("parcel").alias("class"), F.lit(CONFIDENCE).alias("confidence"), F.round("area_sqm", 2).alias("area_sqm"), F.round("perimeter_m", 2).alias("perimeter_m"), "length_m", "width_m", F.coalesce("n", F.lit(0)).alias("buildings_count"), "geom")
