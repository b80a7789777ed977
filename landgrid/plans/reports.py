"""Aggregates, KPIs and report strings (sections 2.I, 2.K, 2.P) and their registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landgrid.functions.text import identifier
from landgrid.plans.views import FEATURES, features, table
from landgrid.registry import Registry

REGISTRY = Registry()
query = REGISTRY.add
# Which feature class stands for which layer in the queries over the supplied tables.
_LAYER = "CASE id % 4 WHEN 0 THEN 'buildings' WHEN 1 THEN 'roads' WHEN 2 THEN 'parcels' ELSE 'land_use' END"


def layer_metrics(rows: DataFrame) -> DataFrame:
    """I1-I4 in one pass over (layer, area_sqm, length_m): counts and totals, zero where a layer is empty."""
    n = lambda k: F.count_if(F.col("layer") == k).alias(k)
    s = lambda k, c: F.coalesce(F.sum(F.when(F.col("layer") == k, F.col(c))), F.lit(0.0))
    return rows.agg(n("buildings"), n("roads"), n("parcels"), n("land_use"), F.round(s("buildings", "area_sqm"), 2).alias("footprint_sqm"), F.round(s("roads", "length_m") / 1000, 3).alias("road_km"), F.round(s("parcels", "area_sqm") / 10000, 3).alias("parcel_ha"))


def ratios(m: DataFrame) -> DataFrame:
    """I6 from the rounded figures, zero where a denominator is zero."""
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return m.select(F.round(safe(F.col("parcel_ha") * 10000, F.col("parcels")), 2).alias("mean_parcel_sqm"), F.round(safe(F.col("footprint_sqm") * 100, F.col("parcel_ha") * 10000), 2).alias("coverage_pct"), F.round(safe(F.col("parcels"), F.col("parcel_ha")), 2).alias("parcels_per_ha"))


def summary_of(layers: dict[str, DataFrame]) -> dict:
    """P3's counts and metrics of a run."""
    rows = None
    for name, df in layers.items():
        col = lambda c, df=df: F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c)
        part = df.select(F.lit(name).alias("layer"), col("area_sqm"), col("length_m"))
        rows = part if rows is None else rows.unionByName(part)
    m = layer_metrics(rows).first()
    return {"counts": {"buildings": m.buildings, "roads": m.roads, "parcels": m.parcels, "land_use_polygons": m.land_use}, "metrics": {"total_building_footprint_sqm": m.footprint_sqm, "total_road_network_km": m.road_km, "total_parcel_area_hectares": m.parcel_ha}}


def audit_report(summary: dict, land_use: DataFrame) -> str:
    """P5: a run's figures, ratios and land use by class, as Markdown."""
    n, m = summary["counts"], summary["metrics"]
    sqm, footprint = m["total_parcel_area_hectares"] * 10000, m["total_building_footprint_sqm"]
    share = lambda a, b: a / b if b > 0 else 0.0
    classes = land_use.groupBy("class").agg(F.sum("area_sqm").alias("a")).orderBy("class").collect()  # a row a class
    lines = [
        "# Land survey report", "",
        f"- Input: {summary['input_file']}", f"- Size: {summary['dimensions_px']} pixels", f"- CRS: {summary['crs']}", f"- Seconds: {summary['processing_time_seconds']}", "",
        "## Figures", "",
        f"- Parcels: {n['parcels']}, {m['total_parcel_area_hectares']:.3f} ha ({sqm:,.1f} m2)",
        f"- Mean parcel: {share(sqm, n['parcels']):,.1f} m2", f"- Parcels a hectare: {share(n['parcels'], m['total_parcel_area_hectares']):.1f}",
        f"- Buildings: {n['buildings']}, {footprint:,.1f} m2", f"- Building coverage: {share(footprint * 100, sqm):.2f} %",
        f"- Roads: {n['roads']}, {m['total_road_network_km']:.3f} km", f"- Land-use polygons: {n['land_use_polygons']}", "",
        "## Land use", "", "| Class | m2 | ha |", "|-|-|-|", *[f"| {r['class']} | {r.a:.2f} | {r.a / 10000:.3f} |" for r in classes],
    ]
    return "\n".join(lines) + "\n"


def _rows(spark, sf):
    return features(spark, sf).withColumn("layer", F.expr(_LAYER))


_M = f"{FEATURES}, l AS (SELECT *, {_LAYER} AS layer FROM feat), m AS (SELECT count(*) FILTER (layer = 'buildings') AS buildings, count(*) FILTER (layer = 'roads') AS roads, count(*) FILTER (layer = 'parcels') AS parcels, count(*) FILTER (layer = 'land_use') AS land_use, round(coalesce(sum(area_sqm) FILTER (layer = 'buildings'), 0), 2) AS footprint_sqm, round(coalesce(sum(length_m) FILTER (layer = 'roads'), 0) / 1000, 3) AS road_km, round(coalesce(sum(area_sqm) FILTER (layer = 'parcels'), 0) / 10000, 3) AS parcel_ha FROM l)"


@query("summary_metrics", f"WITH {_M} SELECT * FROM m")
def summary_metrics(spark, sf):
    return layer_metrics(_rows(spark, sf))


@query("kpi_ratios", f"WITH {_M} SELECT round(CASE WHEN parcels > 0 THEN parcel_ha * 10000 / parcels ELSE 0 END, 2) AS mean_parcel_sqm, round(CASE WHEN parcel_ha > 0 THEN footprint_sqm * 100 / (parcel_ha * 10000) ELSE 0 END, 2) AS coverage_pct, round(CASE WHEN parcel_ha > 0 THEN parcels / parcel_ha ELSE 0 END, 2) AS parcels_per_ha FROM m")
def kpi_ratios(spark, sf):
    return ratios(layer_metrics(_rows(spark, sf)))


@query("layer_counts", f"WITH {_M} SELECT layer, count(*) AS n FROM l GROUP BY layer")
def layer_counts(spark, sf):
    return _rows(spark, sf).groupBy("layer").agg(F.count("*").alias("n"))


@query("class_hectares", f"WITH {FEATURES} SELECT class, round(sum(area_sqm), 1) AS area_sqm, round(sum(area_sqm) / 10000, 3) AS area_hectares FROM feat GROUP BY class")
def class_hectares(spark, sf):
    """I5 over stored features."""
    return features(spark, sf).groupBy("class").agg(F.round(F.sum("area_sqm"), 1).alias("area_sqm"), F.round(F.sum("area_sqm") / 10000, 3).alias("area_hectares")).orderBy("class")


@query("visible_layers", f"WITH {_M} SELECT layer, count(*) AS n, bool_and(area_sqm > 0) AS all_positive FROM l WHERE layer IN ('buildings', 'parcels') GROUP BY layer")
def visible_layers(spark, sf):
    """H-11, I10."""
    return _rows(spark, sf).where(F.col("layer").isin("buildings", "parcels")).groupBy("layer").agg(F.count("*").alias("n"), F.bool_and(F.col("area_sqm") > 0).alias("all_positive"))


@query("id_format", "SELECT p_partkey AS n, printf('BLD_%04d', p_partkey) AS bld, printf('PEG_%03d', p_partkey) AS peg FROM part")
def id_format(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("n"), identifier("BLD_", F.col("p_partkey")).alias("bld"), identifier("PEG_", F.col("p_partkey"), 3).alias("peg"))


@query("tooltip_text", f"WITH {FEATURES} SELECT id, 'ID: ' || printf('LU_%04d', id) || ' | ' || class || ' | ' || upper(class) AS tip FROM feat")
def tooltip_text(spark, sf):
    return features(spark, sf).select("id", F.concat_ws(" | ", F.concat(F.lit("ID: "), identifier("LU_", F.col("id"))), "class", F.upper("class")).alias("tip"))


@query("report_text", f"WITH {_M} SELECT '# Land report' || chr(10) || '- Buildings: ' || buildings || chr(10) || '- Roads: ' || roads || chr(10) || '- Parcels: ' || parcels || chr(10) || '- Land-use polygons: ' || land_use AS report FROM m")
def report_text(spark, sf):
    """P5."""
    m = layer_metrics(_rows(spark, sf))
    line = lambda k, c: F.concat(F.lit(f"- {k}: "), F.col(c).cast("string"))
    return m.select(F.concat_ws("\n", F.lit("# Land report"), line("Buildings", "buildings"), line("Roads", "roads"), line("Parcels", "parcels"), line("Land-use polygons", "land_use")).alias("report"))


@query("summary_json", f"WITH {_M} SELECT '{{\"buildings\":' || buildings || ',\"roads\":' || roads || ',\"parcels\":' || parcels || '}}' AS doc FROM m")
def summary_json(spark, sf):
    """P3."""
    return layer_metrics(_rows(spark, sf)).select(F.to_json(F.struct("buildings", "roads", "parcels")).alias("doc"))


@query("geojson_encode", "SELECT c_custkey AS id, '{\"type\":\"Point\",\"coordinates\":[' || (c_custkey * 37 % 500)::BIGINT || '.0,' || (c_custkey * 91 % 500)::BIGINT || '.0]}' AS doc FROM customer")
def geojson_encode(spark, sf):
    """F28, P2."""
    from landgrid.plans.views import points
    from landgrid.sources.vector import geojson_geometry

    return points(spark, sf).select("id", geojson_geometry("Point", F.array(F.array(F.struct("x", "y")))).alias("doc"))


@query("geojson_explode", "SELECT o_orderkey AS id, (o_orderkey % 100)::DOUBLE AS x, (o_custkey % 100)::DOUBLE AS y FROM orders")
def geojson_explode(spark, sf):
    """Geometry text back to coordinates."""
    from landgrid.sources.vector import rings_of

    o = table(spark, sf, "orders")
    text = F.format_string("[%s.0, %s.0]", (F.col("o_orderkey") % 100).cast("string"), (F.col("o_custkey") % 100).cast("string"))
    return o.select(F.col("o_orderkey").alias("id"), rings_of(F.lit("Point"), text)[0][0].alias("p")).select("id", "p.x", "p.y")
