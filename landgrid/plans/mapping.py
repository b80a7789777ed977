"""The whole mapping run: raster and pegs in, four vector layers and a summary out (sections 2.P, 3.1)."""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landgrid.functions import crs
from landgrid.operators import parcels, raster, segment, topology, vectorize
from landgrid.plans.reports import audit_report, summary_of
from landgrid.shared import materialise
from landgrid.sources import geotiff, vector


def heights(spark: SparkSession, dsm: str | None, dtm: str | None) -> DataFrame | None:
    """A4, A5: a missing surface raster means no boost; a terrain raster alone is ignored."""
    if not dsm or not os.path.exists(dsm):
        return None
    read = lambda p: _bands(geotiff.read_windows(spark, p, overlap=0, bands=1)).select("r", "c", F.col("v").alias("z"))
    return raster.ndsm(read(dsm), read(dtm) if dtm and os.path.exists(dtm) else None)


def _bands(tiles: DataFrame) -> DataFrame:
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for t in batch.to_pylist():
                x = np.frombuffer(t["data"], np.dtype(t["dtype"])).reshape(t["bands"], t["h"], t["w"])[0]
                r, c = np.mgrid[t["row_start"] : t["row_start"] + t["h"], t["col_start"] : t["col_start"] + t["w"]]
                yield pa.RecordBatch.from_arrays([pa.array(r.ravel().astype(np.int32)), pa.array(c.ravel().astype(np.int32)), pa.array(x.ravel().astype(np.float64))], names=["r", "c", "v"])

    return tiles.mapInArrow(run, "r int, c int, v double")


TASKS = ("buildings", "roads", "landuse")


def run(
    spark: SparkSession, ortho: str, out: str | None = None, pegs: str | None = None, dsm: str | None = None, dtm: str | None = None, tile: int = 512, overlap: int = 64,
    min_building: float = 15.0, min_parcel: float = 80.0, tolerance: float = 2.0, compat: bool = False, building_threshold: float = 0.5, road_threshold: float = 0.45,
    orthogonal: bool = True, tasks: tuple[str, ...] = TASKS, progress: Callable[[str, float], None] | None = None,
) -> dict:
    """{layers, summary}. Layers carry ``geom`` as WKB in the raster's CRS.

    ``tasks``: what is scored; layers of the others are empty. ``progress`` hears (stage, share done); the stage is also the
    description of Spark's jobs. A raster without a CRS is an error, unless ``compat`` takes it for EPSG:3857.
    """
    began = time.time()
    if unknown := set(tasks) - set(TASKS):
        raise ValueError(f"unknown tasks {sorted(unknown)}")
    if not os.path.exists(ortho):
        raise FileNotFoundError(ortho)

    def say(stage: str, share: float) -> None:
        spark.sparkContext.setJobDescription(f"landgrid: {stage}")
        if progress:
            progress(stage, share)

    t = geotiff.Tiff(ortho)
    transform, srid = t.transform, t.srid or (3857 if compat else None)
    crs.check_metres(srid)
    say("scoring", 0.0)
    scored = materialise(segment.segment_tiles(geotiff.read_windows(spark, ortho, tile, overlap), overlap, tuple(tasks)), "scored")
    prob = scored.groupBy("r", "c").agg(*[F.least(F.lit(1.0), F.sum(F.col(k) * F.col("w")) / F.when(F.sum("w") == 0, 1.0).otherwise(F.sum("w"))).alias(k) for k in ("buildings", "roads")], F.max(F.struct("conf", (-F.col("tile_no")).alias("t"), "cls")).alias("m"))
    prob = materialise(prob.select("r", "c", "buildings", "roads", F.when(F.col("m.conf") > 0, F.col("m.cls")).otherwise(0).alias("cls")), "blended")
    b = prob.where("buildings IS NOT NULL").select("r", "c", F.col("buildings").alias("p"))
    if (h := heights(spark, dsm, dtm)) is not None:
        b = raster.height_boost(b, h)
    shrink = lambda target: raster.scale_factor(t.width, t.height, target)
    scaled = lambda s: (transform[0] * s, 0.0, transform[2], 0.0, transform[4] * s, transform[5])
    sr, sl, size = shrink(2500), shrink(2000), (t.height, t.width)
    say("buildings", 0.3)
    layers = {"buildings": materialise(vectorize.buildings(b, transform, building_threshold, min_building, orthogonal), "buildings")}
    say("roads", 0.45)
    r = raster.decimate(prob.where("roads IS NOT NULL").select("r", "c", F.col("roads").alias("p")), sr, size, "p")
    layers["roads"] = materialise(vectorize.roads(r, scaled(sr), road_threshold, shape=(t.height // sr, t.width // sr)), "roads")
    say("land use", 0.65)
    layers["land_use"] = vectorize.land_use(raster.decimate(prob.where("cls IS NOT NULL").select("r", "c", "cls"), sl, size), scaled(sl))
    x0, y0 = transform[2], transform[5]
    x1, y1 = x0 + transform[0] * t.width, y0 + transform[4] * t.height
    extent = f"POLYGON (({x0} {y0}, {x1} {y0}, {x1} {y1}, {x0} {y1}, {x0} {y0}))"
    say("parcels", 0.75)
    points = vector.read_pegs(spark, pegs, srid, compat) if pegs and os.path.exists(pegs) else None
    layers["parcels"] = parcels.delineate(extent, layers["roads"], layers["buildings"], points, min_parcel, tolerance)
    say("topology", 0.85)
    layers = {k: materialise(v, f"layer-{k}") for k, v in topology.repair_layers(layers, compat, {"buildings": min_building, "parcels": min_parcel}).items()}
    say("export", 0.95)
    outputs = vector.write_layers(layers, out, srid) if out else {}
    summary = summary_of(layers) | {"processing_time_seconds": round(time.time() - began, 2), "input_file": os.path.abspath(ortho), "dimensions_px": f"{t.width}x{t.height}", "crs": f"EPSG:{srid}", "outputs": outputs}
    if out:
        vector.write_summary(summary, os.path.join(out, "summary.json"))
        Path(out, "report.md").write_text(audit_report(summary, layers["land_use"]), encoding="utf-8")
    say("done", 1.0)
    spark.sparkContext.setJobDescription(None)
    return {"layers": layers, "summary": summary}
