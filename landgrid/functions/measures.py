"""Planar measures as Column expressions over rings: ``array<struct<x:double,y:double>>``; polygons: ``array<ring>``,
outer ring first (F1-F9, F24-F26). All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def _sides(ring: Column, f) -> Column:
    """f(p, q) of each pair of neighbouring vertices."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), f)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def closed(ring: Column) -> Column:
    """The ring with its first vertex repeated at the end, if it isn't yet."""
    first, last = F.element_at(ring, 1), F.element_at(ring, -1)
    return F.when(F.size(ring) == 0, ring).when(first == last, ring).otherwise(F.concat(ring, F.array(first)))


def signed_area(ring: Column) -> Column:
    return total(_sides(ring, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])) / 2


def ring_area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def line_length(line: Column) -> Column:
    return total(_sides(line, lambda p, q: F.sqrt((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"]))))


def polygon_area(rings: Column) -> Column:
    """Outer ring minus holes."""
    holes = F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0)))
    return ring_area(F.element_at(rings, 1)) - total(F.transform(holes, ring_area))


def polygon_perimeter(rings: Column) -> Column:
    """All rings, holes included."""
    return total(F.transform(rings, line_length))


def ring_centroid(ring: Column) -> Column:
    """Area-weighted centre; the mean of the vertices where the area is zero. Vertices are taken from the first one."""
    o = F.element_at(ring, 1)
    local = F.transform(ring, lambda p: F.struct((p["x"] - o["x"]).alias("x"), (p["y"] - o["y"]).alias("y")))
    cross = lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]
    a6 = signed_area(local) * 6
    cx = total(_sides(local, lambda p, q: (p["x"] + q["x"]) * cross(p, q)))
    cy = total(_sides(local, lambda p, q: (p["y"] + q["y"]) * cross(p, q)))
    mean = lambda c: total(F.transform(local, lambda p: p[c])) / F.size(local)
    return F.struct((o["x"] + F.when(a6 == 0, mean("x")).otherwise(cx / a6)).alias("x"), (o["y"] + F.when(a6 == 0, mean("y")).otherwise(cy / a6)).alias("y"))


def bounds(ring: Column) -> Column:
    x, y = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(x).alias("minx"), F.array_min(y).alias("miny"), F.array_max(x).alias("maxx"), F.array_max(y).alias("maxy"))


def box_ring(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """counter-clockwise from the lower right, closed."""
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(at(maxx, miny), at(maxx, maxy), at(minx, maxy), at(minx, miny), at(maxx, miny))


def rotate(ring: Column, degrees: Column, centre: Column) -> Column:
    s, c = F.sin(F.radians(degrees)), F.cos(F.radians(degrees))

    def turn(p):
        dx, dy = p["x"] - centre["x"], p["y"] - centre["y"]
        return F.struct((centre["x"] + dx * c - dy * s).alias("x"), (centre["y"] + dx * s + dy * c).alias("y"))

    return F.transform(ring, turn)


def dominant_angle(p: Column, q: Column) -> Column:
    """Direction of an edge, modulo a quarter turn; never negative."""
    return F.pmod(F.degrees(F.atan2(q["y"] - p["y"], q["x"] - p["x"])), F.lit(90.0))


def box_dimensions(b: Column) -> tuple[Column, Column]:
    """F3's fallback: (length, width) of a bounding box, two decimals."""
    w, h = b["maxx"] - b["minx"], b["maxy"] - b["miny"]
    return F.round(F.greatest(w, h), 2), F.round(F.least(w, h), 2)


def compactness(area: Column, perimeter: Column) -> Column:
    """F26 with its truncated constant; null where there is no perimeter."""
    return F.when(perimeter > 0, 4 * F.lit(3.14159265) * area / (perimeter * perimeter))


def interpolate(line: Column, share: Column) -> Column:
    """the point at a share of a line's length; one pass that carries the running length."""
    goal = line_length(line) * share
    first = F.element_at(line, 1)
    zero = F.struct(F.lit(0.0).alias("run"), first.alias("at"), first.alias("last"))

    def step(a, q):
        p = a["last"]
        d = F.sqrt((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"]))
        t = F.when(d > 0, F.least(F.greatest((goal - a["run"]) / d, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        here = (a["run"] <= goal) & (d > 0)
        at = F.when(here, F.struct((p["x"] + t * (q["x"] - p["x"])).alias("x"), (p["y"] + t * (q["y"] - p["y"])).alias("y"))).otherwise(a["at"])
        return F.struct((a["run"] + d).alias("run"), at.alias("at"), q.alias("last"))

    return F.aggregate(F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0))), zero, step)["at"]


def contains(ring: Column, x: Column, y: Column, boundary: bool = False) -> Column:
    """Ray casting over a closed ring; points on the boundary count only if ``boundary`` (F19 strict, F20 not)."""

    def on(p, q):
        cross = (q["x"] - p["x"]) * (y - p["y"]) - (q["y"] - p["y"]) * (x - p["x"])
        return (cross == 0) & x.between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & y.between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))

    def crosses(p, q):
        return ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"])

    edge = F.exists(_sides(ring, on), lambda b: b)
    odd = F.aggregate(_sides(ring, lambda p, q: F.when(crosses(p, q), 1).otherwise(0)), F.lit(0), lambda a, b: a + b) % 2 == 1
    return edge | odd if boundary else odd & ~edge


def wkt(kind: str, rings: Column) -> Column:
    """Text form for the overlay functions; ``rings``: a polygon's rings, a line's or point list's vertices."""
    coords = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit(")"))
    if kind == "POLYGON":
        return F.concat(F.lit("POLYGON ("), F.array_join(F.transform(rings, coords), ", "), F.lit(")"))
    return F.concat(F.lit(kind + " "), coords(rings))
