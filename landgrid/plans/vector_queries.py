"""Registered queries of geometry measures, spatial joins, filters and topology (sections 2.E-2.H, 2.K-2.N)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from landgrid.functions import crs
from landgrid.functions import measures as M
from landgrid.operators import graph, joins, parcels, topology
from landgrid.plans.views import BOXES, FEATURES, POINTS, VERTICES, boxes, features, lines, points, rings, table
from landgrid.registry import Registry

REGISTRY = Registry()
query = REGISTRY.add


@query("ring_area_perimeter", f"WITH {VERTICES} SELECT id, round(abs(sum(x1 * y2 - x2 * y1)) / 2, 2) AS area_sqm, round(sum(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)), 2) AS perimeter_m FROM rseg GROUP BY id")
def ring_area_perimeter(spark, sf):
    r = F.col("ring")
    return rings(spark, sf).select("id", F.round(M.ring_area(r), 2).alias("area_sqm"), F.round(M.line_length(r), 2).alias("perimeter_m"))


@query("line_length", f"WITH {VERTICES} SELECT id, round(sum(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)), 2) AS length_m FROM seg GROUP BY id")
def line_length(spark, sf):
    return lines(spark, sf).select("id", F.round(M.line_length(F.col("line")), 2).alias("length_m"))


@query("bounds", f"WITH {VERTICES} SELECT id, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM lv WHERE n >= 2 GROUP BY id")
def bounds(spark, sf):
    return lines(spark, sf).select("id", M.bounds(F.col("line")).alias("b")).select("id", "b.*")


@query("total_bounds", f"WITH {VERTICES} SELECT min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy FROM lv WHERE n >= 2")
def total_bounds(spark, sf):
    """extent and centre of a layer."""
    b = lines(spark, sf).select(M.bounds(F.col("line")).alias("b")).agg(F.min("b.minx").alias("minx"), F.min("b.miny").alias("miny"), F.max("b.maxx").alias("maxx"), F.max("b.maxy").alias("maxy"))
    return b.select("*", ((F.col("minx") + F.col("maxx")) / 2).alias("cx"), ((F.col("miny") + F.col("maxy")) / 2).alias("cy"))


@query("centroid", f"""WITH {VERTICES}, o AS (SELECT id, x AS ox, y AS oy, n FROM rv WHERE k = 1),
l AS (SELECT s.id, x1 - ox AS x1, y1 - oy AS y1, x2 - ox AS x2, y2 - oy AS y2, ox, oy FROM rseg s JOIN o USING (id)),
a AS (SELECT id, sum(x1 * y2 - x2 * y1) * 3 AS a6, sum((x1 + x2) * (x1 * y2 - x2 * y1)) AS cx, sum((y1 + y2) * (x1 * y2 - x2 * y1)) AS cy, max(ox) AS ox, max(oy) AS oy FROM l GROUP BY id)
SELECT id, round(ox + cx / a6, 2) AS x, round(oy + cy / a6, 2) AS y FROM a WHERE a6 <> 0""")
def centroid(spark, sf):
    r = rings(spark, sf).where(M.signed_area(F.transform("ring", lambda p: F.struct((p["x"] - F.col("ring")[0]["x"]).alias("x"), (p["y"] - F.col("ring")[0]["y"]).alias("y")))) != 0)
    return r.select("id", M.ring_centroid(F.col("ring")).alias("p")).select("id", F.round("p.x", 2).alias("x"), F.round("p.y", 2).alias("y"))


@query("rotate", f"WITH {VERTICES} SELECT id, round(sum((x - 100) * cos(radians(30)) - (y - 50) * sin(radians(30)) + 100), 2) AS sx, round(sum((x - 100) * sin(radians(30)) + (y - 50) * cos(radians(30)) + 50), 2) AS sy FROM lv WHERE n >= 2 GROUP BY id")
def rotate(spark, sf):
    t = M.rotate(F.col("line"), F.lit(30.0), F.struct(F.lit(100.0).alias("x"), F.lit(50.0).alias("y")))
    return lines(spark, sf).select("id", t.alias("t")).select("id", F.round(M.total(F.transform("t", lambda p: p["x"])), 2).alias("sx"), F.round(M.total(F.transform("t", lambda p: p["y"])), 2).alias("sy"))


@query("dominant_angle", f"WITH {VERTICES} SELECT id, round(((degrees(atan2(y2 - y1, x2 - x1)) % 90) + 90) % 90, 6) AS angle FROM seg WHERE k = 1")
def dominant_angle(spark, sf):
    return lines(spark, sf).select("id", F.round(M.dominant_angle(F.col("line")[0], F.col("line")[1]), 6).alias("angle"))


@query("interpolate", f"""WITH {VERTICES}, d AS (SELECT *, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS d FROM seg), c AS (SELECT *, sum(d) OVER (PARTITION BY id ORDER BY k) - d AS run, sum(d) OVER (PARTITION BY id) AS total FROM d),
g AS (SELECT c.*, s, s * total AS goal FROM c CROSS JOIN (VALUES (0.25::DOUBLE), (0.5)) v(s)), h AS (SELECT *, row_number() OVER (PARTITION BY id, s ORDER BY k DESC) AS j FROM g WHERE d > 0 AND run <= goal)
SELECT id, s AS share, round(x1 + (x2 - x1) * least(1, (goal - run) / d), 2) AS x, round(y1 + (y2 - y1) * least(1, (goal - run) / d), 2) AS y FROM h WHERE j = 1""")
def interpolate(spark, sf):
    at = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), M.interpolate(F.col("line"), F.lit(s)).alias("p")) for s in (0.25, 0.5)]))
    return lines(spark, sf).where(M.line_length(F.col("line")) > 0).select("id", at.alias("a")).select("id", F.col("a.s").alias("share"), F.round("a.p.x", 2).alias("x"), F.round("a.p.y", 2).alias("y"))


@query("compactness", f"WITH {FEATURES} SELECT id, round(4 * 3.14159265::DOUBLE * area_sqm / (perimeter_m * perimeter_m), 4) AS compactness FROM feat WHERE perimeter_m > 0")
def compactness(spark, sf):
    return features(spark, sf).where("perimeter_m > 0").select("id", F.round(M.compactness(F.col("area_sqm"), F.col("perimeter_m")), 4).alias("compactness"))


_LL = "SELECT c_custkey AS id, (c_custkey * 37 % 360 - 180)::DOUBLE AS lon, (c_custkey * 91 % 160 - 80)::DOUBLE AS lat FROM customer"


def _lonlat(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("id"), (k * 37 % 360 - 180).cast("double").alias("lon"), (k * 91 % 160 - 80).cast("double").alias("lat"))


@query("mercator_forward", f"WITH t AS ({_LL}) SELECT id, round(radians(lon) * 6378137, 2) AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137, 2) AS y FROM t")
def mercator_forward(spark, sf):
    x, y = crs.to_mercator(F.col("lon"), F.col("lat"))
    return _lonlat(spark, sf).select("id", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))


@query("mercator_inverse", f"WITH t AS ({_LL}) SELECT id, round(degrees(lon * 100000 / 6378137), 6) AS lon, round(degrees(2 * atan(exp(lat * 100000 / 6378137)) - pi() / 2), 6) AS lat FROM t")
def mercator_inverse(spark, sf):
    lon, lat = crs.to_lonlat(F.col("lon") * 100000, F.col("lat") * 100000)
    return _lonlat(spark, sf).select("id", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


_PAIRS = f"WITH {BOXES}, p AS (SELECT a.id AS a, b.id AS b, greatest(0, least(a.maxx, b.maxx) - greatest(a.minx, b.minx)) * greatest(0, least(a.maxy, b.maxy) - greatest(a.miny, b.miny)) AS area, (a.maxx - a.minx) * (a.maxy - a.miny) AS own FROM boxes a JOIN boxes b ON a.id < b.id AND a.minx <= b.maxx AND b.minx <= a.maxx AND a.miny <= b.maxy AND b.miny <= a.maxy)"


def _pairs(spark, sf):
    """Distinct boxes p, q that meet, with their ids, the area of the overlap and their own areas; ``joins.each_pair`` makes the pairs of ids."""
    p = joins.meeting_copies(joins.copies(boxes(spark, sf)), 10.0)
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(f"p_{hi}", f"q_{hi}") - F.greatest(f"p_{lo}", f"q_{lo}"))
    own = lambda k: (F.col(f"{k}_maxx") - F.col(f"{k}_minx")) * (F.col(f"{k}_maxy") - F.col(f"{k}_miny"))
    return p.withColumn("area", side("minx", "maxx") * side("miny", "maxy")).withColumn("p_own", own("p")).withColumn("q_own", own("q"))


@query("overlap_pairs", _PAIRS + " SELECT a, b FROM p")
def overlap_pairs(spark, sf):
    return joins.overlapping_boxes(boxes(spark, sf), 10.0)


@query("box_intersection", _PAIRS + " SELECT a, b, round(area, 3) AS area FROM p WHERE area > 0")
def box_intersection(spark, sf):
    p = _pairs(spark, sf).where("area > 0").withColumn("area", F.round("area", 3))
    return joins.each_pair(p, "area").select("a", "b", "area")


@query("box_difference_area", _PAIRS + " SELECT a, b, round(own - area, 3) AS area FROM p")
def box_difference_area(spark, sf):
    rest = lambda k: F.round(F.col(f"{k}_own") - F.col("area"), 3).alias(f"{k}_rest")
    p = _pairs(spark, sf).select("p_keys", "q_keys", "same", rest("p"), rest("q"))
    return joins.each_pair(p, "p_rest", "q_rest").select("a", "b", F.when(F.col("p_first"), F.col("p_rest")).otherwise(F.col("q_rest")).alias("area"))


@query("overlay_box_areas", _PAIRS + " SELECT a, b, round(area, 3) AS both_, round(own - area, 3) AS only_a FROM p")
def overlay_box_areas(spark, sf):
    """F17, F18 by the overlay functions, against the boxes' closed form."""
    from landgrid.functions import overlay

    overlay.install(spark)
    p = joins.meeting_copies(joins.copies(boxes(spark, sf)), 10.0)
    less = lambda x, y: F.array_min(f"{x}_keys") < F.array_max(f"{y}_keys")  # some pair has its a in x
    sides = [f"{k}_{s}" for k in "pq" for s in joins.SIDES]
    p = p.withColumn("first", less("p", "q")).withColumn("second", less("q", "p")).where("first OR second")
    p = p.select("p_keys", "q_keys", "same", overlay.call("BoxAreas", *sides, "first", "second").alias("areas"))
    p = p.select("p_keys", "q_keys", "same", *[F.round(F.col("areas")[i], 3).alias(k) for i, k in enumerate(("both_", "only_p", "only_q"))])
    return joins.each_pair(p, "both_", "only_p", "only_q").select("a", "b", "both_", F.when(F.col("p_first"), F.col("only_p")).otherwise(F.col("only_q")).alias("only_a"))


@query("corridor_box", "SELECT p_partkey AS id, round((p_size + 2 * greatest(1.5, p_size % 7 / 2.0::DOUBLE)) * 2 * greatest(1.5, p_size % 7 / 2.0::DOUBLE), 3) AS area FROM part")
def corridor_box(spark, sf):
    """F15, M-2: corridor of an axis-aligned road of length p_size, square caps."""
    from landgrid.functions import overlay

    overlay.install(spark)
    at = lambda x: F.struct(x.cast("double").alias("x"), F.lit(0.0).alias("y"))
    line = M.wkt("LINESTRING", F.array(at(F.lit(0)), at(F.col("p_size"))))
    d = F.greatest(F.lit(1.5), F.col("p_size") % 7 / 2.0)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.round(overlay.call("Area", overlay.call("Corridor", overlay.call("FromText", line), d)), 3).alias("area"))


@query("point_in_box_join", f"WITH {BOXES}, {POINTS} SELECT boxes.id, pts.id AS point_id FROM boxes JOIN pts ON x > minx AND x < maxx AND y > miny AND y < maxy")
def point_in_box_join(spark, sf):
    p = points(spark, sf).withColumnRenamed("id", "point_id")
    return joins.points_in_boxes(p, boxes(spark, sf), 5.0).select("id", "point_id")


@query("building_count_left_join", f"WITH {BOXES}, {POINTS} SELECT boxes.id, count(pts.id) AS buildings_count FROM boxes LEFT JOIN pts ON x >= minx AND x <= maxx AND y >= miny AND y <= maxy GROUP BY boxes.id")
def building_count_left_join(spark, sf):
    """G2."""
    b = boxes(spark, sf)
    n = joins.points_in_boxes(points(spark, sf).withColumnRenamed("id", "pid"), b, 5.0, strict=False).groupBy("id").agg(F.count("*").alias("n"))
    return b.select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("buildings_count"))


@query("nearest_peg_snap", f"WITH {POINTS}, d AS (SELECT p.id, s.id AS tid, s.x AS tx, s.y AS ty, (p.x - s.x) ** 2 + (p.y - s.y) ** 2 AS d2 FROM pts p JOIN seeds s ON (p.x - s.x) ** 2 + (p.y - s.y) ** 2 <= 400), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, tid) AS k FROM d) SELECT id, tid, tx, ty, round(sqrt(d2), 6) AS dist FROM r WHERE k = 1")
def nearest_peg_snap(spark, sf):
    t = points(spark, sf, "supplier").toDF("tid", "tx", "ty")
    return joins.nearest_within(points(spark, sf), t, 20.0).withColumn("dist", F.round("dist", 6))


@query("nearest_seed_voronoi", f"WITH {POINTS}, g AS (SELECT i AS gx, j AS gy FROM generate_series(0, 24) a(i), generate_series(0, 24) b(j)), d AS (SELECT gx, gy, id, row_number() OVER (PARTITION BY gx, gy ORDER BY (gx * 20 - x) ** 2 + (gy * 20 - y) ** 2, id) AS k FROM g CROSS JOIN (SELECT * FROM seeds WHERE id <= 8)) SELECT id AS seed, count(*) AS pixels FROM d WHERE k = 1 GROUP BY id")
def nearest_seed_voronoi(spark, sf):
    """F22 in raster form: each grid point of a block takes its nearest seed; the block's seeds are one short array."""
    seeds = points(spark, sf, "supplier").where("id <= 8").agg(F.array_sort(F.collect_list(F.struct("id", "x", "y"))).alias("s"))
    grid = spark.range(625).select(F.expr("id div 25").alias("gx"), (F.col("id") % 25).alias("gy"))
    dist = lambda s: F.pow(F.col("gx") * 20 - s["x"], F.lit(2)) + F.pow(F.col("gy") * 20 - s["y"], F.lit(2))
    near = F.array_min(F.transform("s", lambda s: F.struct(dist(s).alias("d"), s["id"].alias("id"))))["id"]
    return grid.join(F.broadcast(seeds)).select(near.alias("seed")).groupBy("seed").agg(F.count("*").alias("pixels"))


@query("width_sampling", f"""WITH {VERTICES}, d AS (SELECT *, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS d FROM seg), c AS (SELECT *, sum(d) OVER (PARTITION BY id ORDER BY k) - d AS run, sum(d) OVER (PARTITION BY id) AS total FROM d),
g AS (SELECT c.*, s, s * total AS goal FROM c CROSS JOIN (VALUES (0.1::DOUBLE), (0.3), (0.5), (0.7), (0.9)) v(s)), h AS (SELECT *, row_number() OVER (PARTITION BY id, s ORDER BY k DESC) AS j FROM g WHERE d > 0 AND run <= goal),
p AS (SELECT id, floor(x1 + (x2 - x1) * least(1, (goal - run) / d))::BIGINT AS cx, floor(y1 + (y2 - y1) * least(1, (goal - run) / d))::BIGINT AS cy FROM h WHERE j = 1),
w AS (SELECT p_partkey AS cx, p_size % 11 / 2.0::DOUBLE AS w FROM part WHERE p_partkey % 2 = 0),
a AS (SELECT p.id, round(greatest(1.5, round(coalesce(avg(w.w), 2.0), 1)), 1) AS width_m FROM p LEFT JOIN w USING (cx) GROUP BY p.id)
SELECT id, width_m, CASE WHEN width_m >= 4 THEN 'road' ELSE 'pathway' END AS class FROM a""")
def width_sampling(spark, sf):
    """Five points along each line look up a width raster."""
    shares = F.array(*[M.interpolate(F.col("line"), F.lit(s)) for s in (0.1, 0.3, 0.5, 0.7, 0.9)])
    p = lines(spark, sf).where(M.line_length(F.col("line")) > 0).select("id", F.explode(shares).alias("p")).select("id", F.floor("p.x").alias("cx"))
    w = table(spark, sf, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("cx"), (F.col("p_size") % 11 / 2.0).alias("w"))
    width = F.greatest(F.lit(1.5), F.round(F.coalesce(F.avg("w"), F.lit(2.0)), 1))
    return p.join(w, "cx", "left").groupBy("id").agg(width.alias("width_m")).withColumn("class", graph.road_class(F.col("width_m")))


@query("road_classify", f"WITH {VERTICES}, l AS (SELECT id, round(sum(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)), 2) AS length_m FROM seg GROUP BY id) SELECT CASE WHEN id % 9 >= 4 THEN 'road' ELSE 'pathway' END AS class, count(*) AS n, round(sum(length_m), 1) AS length_m FROM l WHERE length_m >= 10 GROUP BY 1")
def road_classify(spark, sf):
    """E8, E9."""
    l = lines(spark, sf).select("id", F.round(M.line_length(F.col("line")), 2).alias("length_m")).where("length_m >= 10")
    return l.groupBy(graph.road_class(F.col("id") % 9).alias("class")).agg(F.count("*").alias("n"), F.round(F.sum("length_m"), 1).alias("length_m"))


@query("clean_types", "WITH t AS (SELECT p_partkey AS id, CASE p_size % 7 WHEN 0 THEN NULL WHEN 1 THEN 'Polygon' WHEN 2 THEN 'MultiPolygon' WHEN 3 THEN 'LineString' WHEN 4 THEN 'MultiLineString' WHEN 5 THEN 'Point' ELSE 'GeometryCollection' END AS kind FROM part) SELECT kind, count(*) AS n FROM t WHERE kind IN ('Polygon', 'MultiPolygon', 'LineString', 'MultiLineString') GROUP BY kind")
def clean_types(spark, sf):
    """H-1, H-2."""
    names = F.array(*[F.lit(x) for x in ("Polygon", "MultiPolygon", "LineString", "MultiLineString", "Point", "GeometryCollection")])
    t = table(spark, sf, "part").select(F.when(F.col("p_size") % 7 > 0, F.element_at(names, (F.col("p_size") % 7).cast("int"))).alias("kind"))
    return t.where(topology.kept_kind(F.col("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


@query("sliver_filter", f"WITH {BOXES}, m AS (SELECT id, (maxx - minx) * (maxy - miny) AS area_sqm, 2 * (maxx - minx + maxy - miny) AS perimeter_m FROM boxes) SELECT id FROM m WHERE area_sqm >= 60 AND NOT (perimeter_m > 0 AND 4 * 3.14159265::DOUBLE * area_sqm / (perimeter_m * perimeter_m) < 0.7)")
def sliver_filter(spark, sf):
    """H-3, H-4 (with limits that bite on these boxes)."""
    w, h = F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")
    m = boxes(spark, sf).select("id", (w * h).alias("area_sqm"), (2 * (w + h)).alias("perimeter_m"))
    return topology.without_slivers(m, 60.0, 0.7).select("id")


@query("lot_split", f"WITH {BOXES}, b AS (SELECT id, minx, miny, minx + (maxx - minx) * 10 AS maxx, miny + (maxy - miny) * 10 AS maxy FROM boxes), s AS (SELECT *, maxx - minx AS dx, maxy - miny AS dy, (maxx - minx) * (maxy - miny) AS area FROM b), t AS (SELECT *, area > 4000 AND dx > dy AND dx > 60 AS big FROM s), l AS (SELECT id, 1 AS lot, minx, CASE WHEN big THEN (minx + maxx) / 2 ELSE maxx END AS maxx, dy FROM t UNION ALL SELECT id, 2, (minx + maxx) / 2, maxx, dy FROM t WHERE big) SELECT id, lot, round(minx, 3) AS minx, round(maxx, 3) AS maxx, round((maxx - minx) * dy, 3) AS area FROM l WHERE (maxx - minx) * dy >= 80")
def lot_split(spark, sf):
    """H-10, M-6."""
    b = boxes(spark, sf)
    b = b.withColumn("maxx", F.col("minx") + (F.col("maxx") - F.col("minx")) * 10).withColumn("maxy", F.col("miny") + (F.col("maxy") - F.col("miny")) * 10)
    return parcels.split_box_lots(b, 80.0).select("id", "lot", F.round("minx", 3).alias("minx"), F.round("maxx", 3).alias("maxx"), F.round("area", 3).alias("area"))


@query("largest_part", "SELECT o_custkey AS id, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS part, max(o_totalprice) AS area FROM orders GROUP BY 1")
def largest_part(spark, sf):
    """Top part of each multi-geometry."""
    best = F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k"))).alias("m")
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(best).select("id", (-F.col("m.k")).alias("part"), F.col("m.o_totalprice").alias("area"))


@query("parcels_sorted", f"WITH {FEATURES} SELECT id, round(area_sqm, 2) AS area_sqm, row_number() OVER (ORDER BY area_sqm DESC, id) AS rank FROM feat ORDER BY rank LIMIT 25")
def parcels_sorted(spark, sf):
    """K1, K6: the largest parcels; the report's table of 25."""
    top = features(spark, sf).orderBy(F.col("area_sqm").desc(), "id").limit(25)
    return top.select("id", F.round("area_sqm", 2).alias("area_sqm"), F.row_number().over(Window.orderBy(F.col("area_sqm").desc(), "id")).alias("rank"))


@query("planar_partition", None)
def planar_partition(spark, sf):
    """N3 over the overlapping boxes: every overlap component is folded in order of area."""
    b = boxes(spark, sf)
    g = b.select("id", M.wkt("POLYGON", F.array(M.box_ring(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy")))).alias("wkt"))
    return topology.resolve_overlaps(topology.from_text(spark, g, "wkt")).select("id", F.round("area_sqm", 3).alias("area_sqm"), F.round("perimeter_m", 3).alias("perimeter_m"))


@query("simplify", None)
def simplify(spark, sf):
    """F7."""
    from landgrid.functions import overlay

    g = topology.from_text(spark, lines(spark, sf).select("id", M.wkt("LINESTRING", F.col("line")).alias("wkt")), "wkt")
    return g.select("id", F.round(overlay.call("Length", overlay.call("Simplify", "geom", 1.0)), 3).alias("length_m"))


@query("make_valid", None)
def make_valid(spark, sf):
    """F11, F12, N1 on rings that cross themselves."""
    g = topology.from_text(spark, rings(spark, sf).select("id", M.wkt("POLYGON", F.array(F.col("ring"))).alias("wkt")), "wkt")
    return topology.clean(g).select("id", F.round("area_sqm", 2).alias("area_sqm"))


@query("orthogonalize", f"WITH {BOXES} SELECT id, round(greatest(maxx - minx, maxy - miny), 2) AS length_m, round(least(maxx - minx, maxy - miny), 2) AS width_m FROM boxes")
def orthogonalize(spark, sf):
    """F3, F9, F10."""
    r = boxes(spark, sf).select("id", M.rotate(M.box_ring(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy")), (F.col("id") % 45).cast("double"), F.struct("minx", "miny").cast("struct<x:double,y:double>")).alias("ring"))
    g = topology.from_text(spark, r.select("id", M.wkt("POLYGON", F.array("ring")).alias("wkt")), "wkt")
    return topology.with_dimensions(topology.orthogonalised(g)).select("id", "length_m", "width_m")


@query("voronoi_cells", None)
def voronoi_cells(spark, sf):
    """F22, M-5: cells of all suppliers in one block; their places, each a seed, are at most 500."""
    from landgrid.functions import overlay

    overlay.install(spark)
    seed = overlay.call("FromText", F.concat(F.lit("POINT ("), F.col("x").cast("string"), F.lit(" "), F.col("y").cast("string"), F.lit(")")))
    seeds = points(spark, sf, "supplier").select("x", "y").distinct().agg(F.array_sort(F.collect_list(seed)).alias("s"))
    block = overlay.call("FromText", F.lit("POLYGON ((0 0, 500 0, 500 500, 0 500, 0 0))"))
    return seeds.select(F.posexplode(overlay.call("VoronoiCells", "s", block, 10.0)).alias("cell", "g")).select("cell", F.round(overlay.call("Area", "g"), 2).alias("area"))
