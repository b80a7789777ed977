"""Masks and class maps to vector layers (D-1 to D-10, E1-E10): components in parallel, NumPy inside one component."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landgrid.functions import overlay
from landgrid.operators import graph, raster, topology
from landgrid.operators.segment import CLASSES
from landgrid.shared import materialise

# Confidences of layers that have no measured one.
ROAD_CONFIDENCE, LANDUSE_CONFIDENCE = 0.88, 0.85
_AROUND = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]  # clockwise, rows downwards


def outline(on: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """D-3: outer border of an 8-connected pixel set, through pixel centres, straight runs merged. Moore tracing."""
    start = min(on)
    path, at, back = [start], start, 4
    first_step = None
    while True:
        for k in range(1, 9):
            d = (back + k) % 8
            nxt = (at[0] + _AROUND[d][0], at[1] + _AROUND[d][1])
            if nxt in on:
                break
        else:
            return path
        if first_step is None:
            first_step = (at, d)
        elif (at, d) == first_step:
            break
        path.append(nxt)
        at, back = nxt, (d + 4) % 8
    ring = path[:-1] if path[-1] == path[0] else path
    n = len(ring)
    turn = lambda i: (ring[i][0] - ring[i - 1][0], ring[i][1] - ring[i - 1][1]) != (ring[(i + 1) % n][0] - ring[i][0], ring[(i + 1) % n][1] - ring[i][1])
    return [ring[i] for i in range(n) if turn(i)] if n > 2 else ring


def edge_rings(on: set[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """D-10: rings along pixel edges, holes included; opposite edges of inner pixels cancel. Largest ring first."""
    nxt: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r, c in on:
        for a, b, q in (((r, c), (r, c + 1), (r - 1, c)), ((r, c + 1), (r + 1, c + 1), (r, c + 1)), ((r + 1, c + 1), (r + 1, c), (r + 1, c)), ((r + 1, c), (r, c), (r, c - 1))):
            if q not in on:
                nxt.setdefault(a, []).append(b)
    rings = []
    while nxt:
        a = start = min(nxt)
        ring, step = [a], None
        while True:
            out = nxt[a]
            # where two edges leave a corner, the sharper turn keeps 4-connected regions apart
            b = out[0] if len(out) == 1 or step is None else max(out, key=lambda q: step[0] * (q[1] - a[1]) - step[1] * (q[0] - a[0]) < 0)
            out.remove(b)
            if not out:
                del nxt[a]
            step, a = (b[0] - a[0], b[1] - a[1]), b
            if a == start:
                break
            ring.append(a)
        n = len(ring)
        rings.append([ring[i] for i in range(n) if (ring[i][0] - ring[i - 1][0], ring[i][1] - ring[i - 1][1]) != (ring[(i + 1) % n][0] - ring[i][0], ring[(i + 1) % n][1] - ring[i][1])])
    size = lambda p: abs(sum(p[i - 1][0] * p[i][1] - p[i][0] * p[i - 1][1] for i in range(len(p))))
    return sorted(rings, key=size, reverse=True)


def thin(mask: np.ndarray) -> np.ndarray:
    """D-8: Zhang-Suen thinning to a fixed point."""
    m = np.pad(mask.astype(np.uint8), 1)
    while True:
        changed = False
        for odd in (0, 1):
            p = [np.roll(m, (-dr, -dc), (0, 1)) for dr, dc in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]
            n = sum(x.astype(int) for x in p)
            turns = sum(((p[i] == 0) & (p[(i + 1) % 8] == 1)).astype(int) for i in range(8))
            a, b = (p[0] * p[2] * p[4], p[2] * p[4] * p[6]) if not odd else (p[0] * p[2] * p[6], p[0] * p[4] * p[6])
            gone = (m == 1) & (n >= 2) & (n <= 6) & (turns == 1) & (a == 0) & (b == 0)
            if gone.any():
                m[gone], changed = 0, True
        if not changed:
            return m[1:-1, 1:-1].astype(bool)


def distance(mask: np.ndarray) -> np.ndarray:
    """D-7: exact distance of set pixels to the nearest unset one: down the columns, then across the rows.

    A pixel's nearest unset one lies no further across than its own column's distance, so rows are searched outwards only as
    far as some pixel's distance so far; all pixels take a step together.
    """
    h, w = mask.shape
    far = h + w
    down = np.where(mask, far, 0).astype(float)
    for i in range(1, h):
        down[i] = np.minimum(down[i], down[i - 1] + 1)
    for i in range(h - 2, -1, -1):
        down[i] = np.minimum(down[i], down[i + 1] + 1)
    g2 = down**2
    out = g2.copy()
    for d in range(1, w):
        if d * d >= out.max():
            break
        out[:, d:] = np.minimum(out[:, d:], g2[:, :-d] + d * d)
        out[:, :-d] = np.minimum(out[:, :-d], g2[:, d:] + d * d)
    return np.sqrt(out) * mask


def holes(mask: np.ndarray) -> list[tuple[int, int]]:
    """Unset pixels that set ones enclose: runs of unset pixels joined row by row, less what reaches the border."""
    m = np.pad(mask, 1)
    root: list[int] = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    runs, above = [], []
    for r, line in enumerate(m):
        edge = np.flatnonzero(np.diff(np.concatenate([[True], line, [True]]).astype(np.int8)))
        here = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            k = len(root)
            root.append(k)
            for i, x, y in above:
                if x < b and a < y:
                    p, q = find(i), find(k)
                    root[max(p, q)] = min(p, q)
            here.append((k, a, b))
            runs.append((k, r, a, b))
        above = here
    return [(r - 1, c - 1) for k, r, a, b in runs if find(k) != find(0) for c in range(a, b)]


def _wkt_ring(points, t) -> str:
    xy = [f"{t[2] + t[0] * c} {t[5] + t[4] * r}" for r, c in [*points, points[0]]]
    return "(" + ", ".join(xy) + ")"


def buildings(prob: DataFrame, transform: tuple, threshold: float = 0.5, min_area: float = 15.0, orthogonal: bool = True) -> DataFrame:
    """prob (r, c, p) -> id, class, confidence, area_sqm, perimeter_m, length_m, width_m, geom.

    The confidence is the mean probability inside the outer outline, enclosed pixels of other kinds included.
    """
    from landgrid.functions.text import numbered

    spark = prob.sparkSession
    overlay.install(spark)
    mask = raster.closing(raster.opening(prob.select("r", "c", (F.col("p") >= threshold).cast("int").alias("on_")), "on_"), "on_")
    zones = graph.regions(mask.where("on_ = 1").select("r", "c"), four=False)
    cell = raster.pixel_area(transform)

    def trace(pdf: pd.DataFrame) -> pd.DataFrame:
        on = set(zip(pdf.r.tolist(), pdf.c.tolist()))
        p = outline(on)
        a = abs(sum(p[i - 1][0] * p[i][1] - p[i][0] * p[i - 1][1] for i in range(len(p)))) / 2 * cell
        if len(p) < 3 or a < min_area:
            return pd.DataFrame({"zone": pd.Series(dtype="int64"), "wkt": pd.Series(dtype=str), "n": pd.Series(dtype="int64"), "sum": pd.Series(dtype=float), "inner": pd.Series(dtype=object)})
        wkt = f"POLYGON ({_wkt_ring([(r + 0.5, c + 0.5) for r, c in p], transform)})"
        r0, c0 = int(pdf.r.min()), int(pdf.c.min())
        m = np.zeros((int(pdf.r.max()) - r0 + 1, int(pdf.c.max()) - c0 + 1), bool)
        m[pdf.r.to_numpy() - r0, pdf.c.to_numpy() - c0] = True
        return pd.DataFrame({"zone": [int(pdf.zone.iloc[0])], "wkt": [wkt], "n": [len(pdf)], "sum": [float(pdf.p.sum())], "inner": [[{"r": r + r0, "c": c + c0} for r, c in holes(m)]]})

    got = zones.join(prob, ["r", "c"]).groupBy("zone").applyInPandas(trace, "zone long, wkt string, n long, sum double, inner array<struct<r: int, c: int>>")
    got = materialise(got, "outlines")
    inner = got.select("zone", F.explode("inner").alias("q")).select("zone", "q.r", "q.c").join(prob, ["r", "c"]).groupBy("zone").agg(F.count("*").alias("m"), F.sum("p").alias("more"))
    mean = (F.col("sum") + F.coalesce("more", F.lit(0.0))) / (F.col("n") + F.coalesce("m", F.lit(0)))
    got = got.join(inner, "zone", "left").select("zone", "wkt", mean.alias("confidence"))
    g = topology.from_text(spark, got, "wkt").withColumn("geom", overlay.call("LargestPart", overlay.call("MakeValid", "geom"))).where("geom IS NOT NULL")
    if orthogonal:
        g = topology.orthogonalised(topology.orthogonalised(g))
    g = topology.with_dimensions(topology.measured(g)).where(F.col("area_sqm") >= min_area)
    g = numbered(g, "BLD_", ["zone"])
    return g.select("id", F.lit("building").alias("class"), F.round("confidence", 3).alias("confidence"), F.round("area_sqm", 2).alias("area_sqm"), F.round("perimeter_m", 2).alias("perimeter_m"), "length_m", "width_m", "geom")


def land_use(classes: DataFrame, transform: tuple) -> DataFrame:
    """classes (r, c, cls) -> id, class, confidence, area_sqm, perimeter_m, geom; 4-connected regions, background skipped."""
    from landgrid.functions.text import numbered

    spark = classes.sparkSession
    zones = graph.regions(classes.where("cls <> 0").select("r", "c", "cls"), four=True, on=("cls",))

    def trace(pdf: pd.DataFrame) -> pd.DataFrame:
        rings = edge_rings(set(zip(pdf.r.tolist(), pdf.c.tolist())))
        wkt = "POLYGON (" + ", ".join(_wkt_ring(r, transform) for r in rings) + ")"
        return pd.DataFrame({"zone": [int(pdf.zone.iloc[0])], "cls": [int(pdf.cls.iloc[0])], "wkt": [wkt]})

    got = zones.groupBy("zone").applyInPandas(trace, "zone long, cls int, wkt string")
    g = topology.measured(topology.from_text(spark, got, "wkt"))
    label = F.coalesce(F.get(F.array(*map(F.lit, CLASSES)), F.col("cls")), F.concat(F.lit("Class "), F.col("cls").cast("string")))
    g = numbered(g, "LU_", ["zone"])
    return g.select("id", label.alias("class"), F.lit(LANDUSE_CONFIDENCE).alias("confidence"), F.round("area_sqm", 2).alias("area_sqm"), F.round("perimeter_m", 2).alias("perimeter_m"), "geom")


def widths_along(lines: DataFrame, field: DataFrame, transform: tuple, fallback: float, shape: tuple[int, int] | None = None) -> DataFrame:
    """Lines (line, geom) -> line, width_m: mean of the width field (r, c, width; 0 where it has no pixel) at five places along the length.

    ``shape``: rows and columns; places outside are left out, and a line without any takes ``fallback``. Never under 1.5.
    """
    at = F.explode(F.array(*[overlay.call("PointAlong", F.col("geom"), s) for s in (0.1, 0.3, 0.5, 0.7, 0.9)]))
    r, c = raster.map_to_pixel(F.get("p", F.lit(0)), F.get("p", F.lit(1)), transform)
    places = lines.select("line", at.alias("p")).select("line", r.cast("int").alias("r"), c.cast("int").alias("c"))
    if shape:
        places = places.where(F.col("r").between(0, shape[0] - 1) & F.col("c").between(0, shape[1] - 1))
    mean = places.join(field.select("r", "c", "width"), ["r", "c"], "left").groupBy("line").agg(F.avg(F.coalesce("width", F.lit(0.0))).alias("width"))
    return lines.select("line").join(mean, "line", "left").select("line", F.greatest(F.lit(1.5), F.round(F.coalesce("width", F.lit(fallback)), 1)).alias("width_m"))


def roads(prob: DataFrame, transform: tuple, threshold: float = 0.45, min_length: float = 10.0, simplify: float = 1.0, shape: tuple[int, int] | None = None) -> DataFrame:
    """prob (r, c, p) -> id, class, confidence, length_m, width_m, geom: centre lines of the thinned mask.

    Thinning and widths need a whole road network; each connected mask is one group, bounded by decimation beforehand.
    ``shape``: rows and columns of the raster; beyond its border there is nothing that a width could end at.
    """
    from landgrid.functions.text import numbered

    spark = prob.sparkSession
    overlay.install(spark)
    res = raster.pixel_length(transform)
    zones = graph.regions(prob.where(F.col("p") >= threshold).select("r", "c"), four=False)

    def skeleton(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf.r.min()) - 1, int(pdf.c.min()) - 1
        r1, c1 = int(pdf.r.max()) + 2, int(pdf.c.max()) + 2
        if shape:
            r0, c0, r1, c1 = max(r0, 0), max(c0, 0), min(r1, shape[0]), min(c1, shape[1])
        m = np.zeros((r1 - r0, c1 - c0), bool)
        m[pdf.r.to_numpy() - r0, pdf.c.to_numpy() - c0] = True
        wide, keep = distance(m) * res * 2, thin(m)
        r, c = np.nonzero(m)
        return pd.DataFrame({"zone": int(pdf.zone.iloc[0]), "r": (r + r0).astype("int32"), "c": (c + c0).astype("int32"), "width": wide[r, c], "on_": keep[r, c]})

    sk = materialise(zones.groupBy("zone").applyInPandas(skeleton, "zone long, r int, c int, width double, on_ boolean"), "skeleton")
    line = sk.where("on_").select("zone", "r", "c")
    # a layer of under 5 centre pixels is empty, as is a component of under 3
    enough = line.groupBy("zone").agg(F.count("*").alias("n")).where("n >= 3").select("zone")
    line = line.join(enough, "zone", "left_semi") if line.limit(5).count() == 5 else line.limit(0)
    found = graph.trace_chains(graph.edges(line.select("r", "c"), res), line.select("r", "c", "zone"))
    x, y = (lambda p: F.lit(transform[2]) + transform[0] * (p["c"] + 0.5)), (lambda p: F.lit(transform[5]) + transform[4] * (p["r"] + 0.5))
    text = F.concat(F.lit("LINESTRING ("), F.array_join(F.transform("vertices", lambda p: F.concat_ws(" ", x(p).cast("string"), y(p).cast("string"))), ", "), F.lit(")"))
    g = found.where(F.size("vertices") >= 2).withColumn("wkt", text)
    g = topology.from_text(spark, g, "wkt").where("geom IS NOT NULL").withColumn("geom", overlay.call("MakeValid", "geom"))
    g = g.where(overlay.call("Kind", "geom") == "LineString")
    if simplify > 0:
        g = g.withColumn("geom", overlay.call("Simplify", "geom", simplify))
    g = g.withColumn("length_m", F.round(overlay.call("Length", "geom"), 2)).where(F.col("length_m") >= min_length)
    g = g.withColumn("line", F.struct("zone", "line_no"))
    g = g.join(widths_along(g, sk, transform, 4 * res, shape), "line")
    g = numbered(g, "RD_", ["zone", "line_no"])
    return g.select("id", graph.road_class(F.col("width_m")).alias("class"), F.lit(ROAD_CONFIDENCE).alias("confidence"), "length_m", "width_m", "geom")
