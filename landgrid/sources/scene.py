"""Synthetic scene (A12): grass, roads, tree disc and roofs as pixel rows, with surface heights and survey pegs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the scene: origin, resolution, colours, and half-open pixel rectangles (row from, row to, column from, column to).
TRANSFORM = (0.2, 0.0, 8500000.0, 0.0, -0.2, 2100000.0)
SRID = 3857
GRASS, ASPHALT, TREES = (110, 145, 85), (130, 130, 135), (35, 115, 40)
ROOF_COLOURS = {"terracotta": (185, 70, 55), "tin": (200, 205, 210), "concrete": (160, 160, 165)}
ROADS = [(0, None, 480, 544), (480, 530, 0, None), (0, 480, 200, 225)]
TREE_DISC = (200, 850, 80)


# Fixed values of the scene: its roofs as (row from, row to, column from, column to, material).
ROOFS = [
    (100, 220, 80, 180, "terracotta"), (280, 420, 70, 170, "tin"), (120, 260, 260, 420, "concrete"), (310, 430, 270, 430, "terracotta"),
    (580, 720, 100, 250, "tin"), (760, 920, 90, 230, "concrete"), (590, 740, 290, 430, "terracotta"), (780, 930, 300, 440, "tin"),
    (120, 280, 580, 720, "concrete"), (330, 440, 600, 750, "terracotta"), (580, 750, 590, 760, "tin"), (800, 950, 600, 740, "concrete"),
    (600, 740, 800, 950, "terracotta"), (780, 920, 810, 940, "tin"),
]


def roofs(size: int = 1024) -> list[tuple[int, int, int, int, str]]:
    """Those that lie within the scene."""
    return [x for x in ROOFS if x[1] <= size and x[3] <= size]


def pixels(spark: SparkSession, size: int = 1024) -> DataFrame:
    """r, c, b1..b3, z. The noise is a hash of the place, so a scene is the same on every run and partition."""
    df = spark.range(size * size).select(F.expr(f"cast(id div {size} as int)").alias("r"), (F.col("id") % size).cast("int").alias("c"))
    r, c = F.col("r"), F.col("c")
    within = lambda a, b, x, y: (r >= a) & (r < (size if b is None else b)) & (c >= x) & (c < (size if y is None else y))
    noise = F.pmod(F.xxhash64("r", "c"), F.lit(21)).cast("int") - 10
    rgb = lambda t: F.array(*map(F.lit, t))
    colour = F.array(*[F.lit(v) + noise for v in GRASS])
    height = 100 + 0.002 * c + 0.003 * r
    for road in ROADS:
        colour = F.when(within(*road), rgb(ASPHALT)).otherwise(colour)
    y, x, radius = TREE_DISC
    disc = F.sqrt((F.pow(c - x, F.lit(2)) + F.pow(r - y, F.lit(2)))) < radius
    colour, height = F.when(disc, rgb(TREES)).otherwise(colour), height + F.when(disc, 5.5).otherwise(0.0)
    spec = spark.createDataFrame([(k, *x[:4], *ROOF_COLOURS[x[4]]) for k, x in enumerate(roofs(size))] or [(0, 0, 0, 0, 0, 0, 0, 0)], "k int, r1 int, r2 int, c1 int, c2 int, o1 int, o2 int, o3 int")
    df = df.select("r", "c", colour.alias("rgb"), height.alias("z"))
    # broadcast range join with the roof table (fourteen rows); the last roof on a pixel wins
    hit = df.join(F.broadcast(spec), (F.col("r") >= F.col("r1")) & (F.col("r") < F.col("r2")) & (F.col("c") >= F.col("c1")) & (F.col("c") < F.col("c2")), "left")
    hit = hit.groupBy("r", "c").agg(F.max("z").alias("z"), F.max(F.struct("k", "o1", "o2", "o3")).alias("o"), F.first("rgb").alias("rgb"))
    band = lambda i: F.coalesce(F.col(f"o.o{i}"), F.col("rgb")[i - 1]).cast("int").alias(f"b{i}")
    return hit.select("r", "c", band(1), band(2), band(3), (F.col("z") + F.when(F.col("o.k").isNotNull(), 6.5).otherwise(0.0)).alias("z"))


def pegs(spark: SparkSession, size: int = 1024) -> DataFrame:
    """A12d: two pegs a roof, 15 pixels off two of its corners, where they are inside; id, x, y in map units."""
    from landgrid.functions.text import identifier

    spec = spark.createDataFrame([(k, *x[:4]) for k, x in enumerate(roofs(size))], "k int, r1 int, r2 int, c1 int, c2 int")
    at = lambda i, r, c: F.struct(F.lit(i).alias("i"), r.alias("r"), c.alias("c"))
    p = spec.select("k", F.explode(F.array(at(0, F.col("r1") - 15, F.col("c1") - 15), at(1, F.col("r2") + 15, F.col("c2") + 15))).alias("p")).select("k", "p.*")
    p = p.where((F.col("r") >= 0) & (F.col("c") >= 0) & (F.col("r") < size) & (F.col("c") < size))
    from pyspark.sql import Window

    n = F.row_number().over(Window.orderBy("k", "i"))  # two rows a roof
    return p.select(identifier("PEG_", n, 3).alias("id"), (TRANSFORM[2] + TRANSFORM[0] * (F.col("c") + 0.5)).alias("x"), (TRANSFORM[5] + TRANSFORM[4] * (F.col("r") + 0.5)).alias("y"))


def write_scene(spark: SparkSession, folder: str, size: int = 1024) -> dict[str, str]:
    """The scene as ortho.tif and dsm.tif, with pegs.csv in longitude and latitude."""
    import csv
    import math
    import os

    import numpy as np

    from landgrid.sources.geotiff import write_tiff

    os.makedirs(folder, exist_ok=True)
    px = pixels(spark, size).toPandas().sort_values(["r", "c"])
    paths = {k: os.path.join(folder, f) for k, f in (("ortho", "ortho.tif"), ("dsm", "dsm.tif"), ("pegs", "pegs.csv"))}
    write_tiff(paths["ortho"], np.stack([px[f"b{i}"].to_numpy(np.uint8).reshape(size, size) for i in (1, 2, 3)]), TRANSFORM, SRID)
    write_tiff(paths["dsm"], px["z"].to_numpy(np.float32).reshape(1, size, size), TRANSFORM, SRID)
    with open(paths["pegs"], "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["id", "lon", "lat"])
        for p in pegs(spark, size).collect():
            out.writerow([p.id, math.degrees(p.x / 6378137), math.degrees(2 * math.atan(math.exp(p.y / 6378137)) - math.pi / 2)])
    return paths
