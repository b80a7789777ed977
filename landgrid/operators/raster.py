"""Raster operators on pixel tables (one row a pixel) and tile grids: tiling, normalising, blending, elevation (A3, B, C10-C14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def tile_grid(spark: SparkSession, width: int, height: int, tile: int = 512, overlap: int = 64) -> DataFrame:
    """B1, B2: tile origins in row-major order with the window that adds the halo, clipped to the raster."""
    nc, nr = -(-width // tile), -(-height // tile)
    df = spark.range(nr * nc).withColumnRenamed("id", "tile_no")
    r0, c0 = F.expr(f"tile_no div {nc}") * tile, F.col("tile_no") % nc * tile
    lo = lambda o: F.greatest(F.lit(0), o - overlap)
    hi = lambda o, n: F.least(F.lit(n), o + tile + overlap)
    return df.select("tile_no", r0.alias("row_off"), c0.alias("col_off"), lo(r0).alias("row_start"), hi(r0, height).alias("row_end"), lo(c0).alias("col_start"), hi(c0, width).alias("col_end"))


def covering_tiles(px: DataFrame, width: int, height: int, tile: int, overlap: int) -> DataFrame:
    """Each pixel with the tiles whose windows hold it, by arithmetic on its place instead of a range join."""

    def origins(at: Column, n: int) -> Column:
        last = -(-n // tile) - 1
        first = F.greatest(F.lit(0), F.floor((at - tile - overlap) / tile) + 1).cast("int")
        return F.sequence(first, F.least(F.lit(last), F.floor((at + overlap) / tile)).cast("int"))

    nc = -(-width // tile)
    rows = px.withColumn("tr", F.explode(origins(F.col("r"), height))).withColumn("tc", F.explode(origins(F.col("c"), width)))
    return rows.withColumn("tile_no", (F.col("tr") * nc + F.col("tc")).cast("long")).drop("tr", "tc")


def first_three_bands(px: DataFrame, bands: list[str]) -> DataFrame:
    """The first three bands as b1..b3; one band is repeated, a missing third one copies the second."""
    take = [bands[min(i, len(bands) - 1)] for i in range(3)]
    return px.select("r", "c", *[F.col(b).alias(f"b{i}") for i, b in enumerate(take, 1)])


def normalise_uint8(v: Column) -> Column:
    return v / 255.0


def normalise_tile(px: DataFrame, tile: str, bands: tuple[str, ...] = ("b1", "b2", "b3")) -> DataFrame:
    """Minimum and maximum over all bands and pixels of a tile's window; a constant tile becomes zeros.

    Two-step: one row a tile is aggregated map-side and joined back, so no window holds a tile.
    """
    lo, hi = F.least(*map(F.col, bands)), F.greatest(*map(F.col, bands))
    span = px.groupBy(tile).agg(F.min(lo).alias("__lo"), F.max(hi).alias("__hi"))
    out = px.join(span, tile)
    for b in bands:
        out = out.withColumn(b, F.when(F.col("__hi") > F.col("__lo"), (F.col(b) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(0.0))
    return out.drop("__lo", "__hi")


def taper(i: Column, length: Column, overlap: int) -> Column:
    """One-dimensional cosine ramp; ones where there is no room for both ramps."""
    k = F.least(i, length - 1 - i)
    ramp = (1 - F.cos(F.pi() * k / max(overlap - 1, 1))) / 2
    if overlap <= 0:
        return F.lit(1.0)
    return F.when((length >= 2 * overlap) & (k < overlap), F.lit(0.0) if overlap == 1 else ramp).otherwise(1.0)


def blend(parts: DataFrame, value: str = "p", weight: str = "w") -> DataFrame:
    """Weighted overlap-add of tile results; pixels of zero weight become 0. Partial sums combine map-side."""
    s, w = F.sum(F.col(value) * F.col(weight)), F.sum(weight)
    return parts.groupBy("r", "c").agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), s / F.when(w == 0, 1.0).otherwise(w))).alias(value))


def winner_take_all(parts: DataFrame) -> DataFrame:
    """C11: class of the tile with the largest confidence times weight; ties go to the first tile, zero weight to class 0."""
    best = F.max(F.struct(F.col("conf"), (-F.col("tile_no")).alias("t"), F.col("cls")))
    return parts.groupBy("r", "c").agg(best.alias("m")).select("r", "c", F.when(F.col("m.conf") > 0, F.col("m.cls")).otherwise(0).alias("cls"))


def scale_factor(width: int, height: int, target: int) -> int:
    """Python's half-even rounding, at least 1."""
    return max(1, round(max(width, height) / target))


def decimate(px: DataFrame, s: int, size: tuple[int, int] | None = None, value: str | None = None) -> DataFrame:
    """Every s-th pixel of every s-th row.

    ``size``: rows and columns of the raster. Where they are no multiples of s, the ceil(n / s) pixels of an axis go to
    floor(n / s) cells: ``value`` (r, c and it are the columns then) by the shares of area, other columns from the nearest pixel.
    """
    px = _strided(px, s)
    for axis, n in zip("rc", size or ()):
        have, want = -(-n // s), n // s
        if have == want or not want:
            continue
        k = have / want
        at, other = F.col(axis), "c" if axis == "r" else "r"
        if value is None:
            taken = F.explode(F.filter(F.sequence(F.floor(at / k).cast("int"), F.floor((at + 1) / k).cast("int")), lambda i: (F.floor(i * k) == at) & (i < want)))
            px = px.withColumn(axis, taken)
            continue
        parts = px.withColumn("__i", F.explode(F.sequence(F.floor(at / k).cast("int"), F.least(F.lit(want - 1), F.floor((at + 1) / k).cast("int")))))
        share = F.least((F.col("__i") + 1) * k, at + 1.0) - F.greatest(F.col("__i") * k, at + 0.0)
        parts = parts.withColumn("__w", share).where("__w > 0")
        px = parts.groupBy(F.col("__i").alias("__at"), other).agg((F.sum(F.col("__w") * F.col(value)) / F.sum("__w")).alias(value)).withColumnRenamed("__at", axis).select("r", "c", value)
    return px


def _strided(px: DataFrame, s: int) -> DataFrame:
    return px.where((F.col("r") % s == 0) & (F.col("c") % s == 0)).withColumn("r", F.expr(f"r div {s}")).withColumn("c", F.expr(f"c div {s}"))


def pixel_to_map(r: Column, c: Column, t: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    """Centre of a pixel under (a, b, c, d, e, f); rotation terms are not used."""
    return F.lit(t[2]) + t[0] * (c + 0.5), F.lit(t[5]) + t[4] * (r + 0.5)


def map_to_pixel(x: Column, y: Column, t: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    """(row, column) whose cell holds the point."""
    return F.floor((y - t[5]) / t[4]), F.floor((x - t[2]) / t[0])


def pixel_area(t: tuple) -> float:
    return abs(t[0]) * abs(t[4])


def pixel_length(t: tuple) -> float:
    return (abs(t[0]) + abs(t[4])) / 2


def _line(across: str, along: str, half: int):
    return Window.partitionBy(across).orderBy(along).rangeBetween(-half, half)  # by place, so that missing pixels are no neighbours


def padded(grid: DataFrame, values: list[str], half: int = 1) -> DataFrame:
    """The pixels (``__real``) and, with null ``values``, the missing places of each row within ``half`` columns of one.

    A pass along columns then finds the row sums of a neighbouring line also where that line has no pixel in this column:
    at a ragged edge or a hole. A full raster grows by ``half`` places at both ends of a row only.
    """
    row, c = Window.partitionBy("r").orderBy("c"), F.col("c")
    grid = grid.withColumn("__lo", F.greatest(c - half, F.lag("c").over(row) + half + 1)).withColumn("__hi", F.least(c + half, F.lead("c").over(row) - 1))
    span = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.slice(F.array("c"), 1, 0))
    places = F.concat(F.array("c"), span(F.col("__lo"), c - 1), span(c + 1, F.col("__hi")))
    out = grid.withColumn("__at", F.explode(places)).withColumn("__real", F.col("__at") == c).withColumn("c", F.col("__at"))
    for v in values:
        out = out.withColumn(v, F.when(F.col("__real"), F.col(v)))
    return out.drop("__lo", "__hi", "__at")


def box_sum(grid: DataFrame, value: str, out: str, half: int = 1) -> DataFrame:
    """Sum over a (2 half + 1) square with zeros where there is no pixel, as two passes over rows and columns."""
    grid = padded(grid, [value], half).withColumn("__s", F.sum(value).over(_line("r", "c", half)))
    return grid.withColumn(out, F.sum("__s").over(_line("c", "r", half))).where("__real").drop("__s", "__real")


def erode(grid: DataFrame, value: str, half: int = 1) -> DataFrame:
    """Minimum over a square; the border is ignored, as each line's window simply ends there."""
    return grid.withColumn("__m", F.min(value).over(_line("r", "c", half))).withColumn(value, F.min("__m").over(_line("c", "r", half))).drop("__m")


def dilate(grid: DataFrame, value: str, half: int = 1) -> DataFrame:
    return grid.withColumn("__m", F.max(value).over(_line("r", "c", half))).withColumn(value, F.max("__m").over(_line("c", "r", half))).drop("__m")


def opening(grid: DataFrame, value: str, half: int = 1) -> DataFrame:
    """D-1 (3x3), and C13's grey opening with half = 12: mirrored borders add no value to a minimum or maximum that the
    window does not hold already, so ignoring the border equals reflecting it."""
    return dilate(erode(grid, value, half), value, half)


def closing(grid: DataFrame, value: str, half: int = 1) -> DataFrame:
    """D-2."""
    return erode(dilate(grid, value, half), value, half)


def ndsm(dsm: DataFrame, dtm: DataFrame | None = None, half: int = 12) -> DataFrame:
    """(r, c, z) surface minus terrain; without a terrain raster, minus the surface's grey opening."""
    if dtm is None:
        return opening(dsm.withColumn("o", F.col("z")), "o", half).select("r", "c", (F.col("z") - F.col("o")).alias("h"))
    return dsm.join(dtm.withColumnRenamed("z", "g"), ["r", "c"]).select("r", "c", (F.col("z") - F.col("g")).alias("h"))


def height_boost(prob: DataFrame, heights: DataFrame) -> DataFrame:
    """C14: probabilities raised by up to 0.3 with height; pixels without one stay."""
    lift = F.least(F.lit(0.3), F.greatest(F.lit(0.0), F.col("h") / 5.0))
    return prob.join(heights, ["r", "c"], "left").withColumn("p", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("p") + F.coalesce(lift, F.lit(0.0))))).drop("h")


def distance_transform_small(mask: DataFrame, reach: int) -> DataFrame:
    """D-7 for widths up to ``reach`` pixels: distance of each set pixel to the nearest unset one within reach.

    Unset pixels are spread over the offsets around them (an equi-join's worth of rows, not a cross join); pixels further
    than ``reach`` from any unset pixel are left out. ``vectorize.distance`` has the exact transform.
    """
    offsets = [(dr, dc, dr * dr + dc * dc) for dr in range(-reach, reach + 1) for dc in range(-reach, reach + 1) if dr * dr + dc * dc <= reach * reach]
    offs = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc"), F.lit(d).alias("d2")) for a, b, d in offsets])
    zeros = mask.where("NOT on").select("r", "c", F.explode(offs).alias("o")).select((F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"), "o.d2")
    near = zeros.groupBy("r", "c").agg(F.min("d2").alias("d2"))
    return mask.where("on").join(near, ["r", "c"]).select("r", "c", F.sqrt(F.col("d2").cast("double")).alias("dist"))


def zonal_mean(prob: DataFrame, zones: DataFrame, default: float) -> DataFrame:
    """D-6: mean probability of each zone's pixels, three decimals; zones without pixels get the default."""
    return zones.join(prob, ["r", "c"], "left").groupBy("zone").agg(F.round(F.coalesce(F.avg("p"), F.lit(default)), 3).alias("confidence"))
