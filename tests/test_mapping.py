"""The whole run on a small synthetic scene."""

from __future__ import annotations

import json
import os

import pytest

from landgrid import cli
from landgrid.operators import vectorize
from landgrid.plans import mapping
from landgrid.sources import scene, vector


def test_small_scene(spark, tmp_path):
    p = scene.write_scene(spark, str(tmp_path), 256)
    done = mapping.run(spark, p["ortho"], str(tmp_path / "out"), p["pegs"], p["dsm"], tile=128, overlap=16)
    counts = done["summary"]["counts"]
    assert counts["buildings"] >= 1 and counts["parcels"] >= 1 and counts["land_use_polygons"] >= 1
    roof = [r.area_sqm for r in done["layers"]["buildings"].collect()]
    assert any(abs(a - 488.84) < 1e-6 for a in roof)  # the 120 x 100 pixel roof: one pixel of dilation less one of centre tracing
    cols = {"id", "class", "confidence", "area_sqm", "perimeter_m", "length_m", "width_m", "buildings_count", "geom"}
    assert cols == set(done["layers"]["parcels"].columns)
    assert done["layers"]["parcels"].where("area_sqm <= 0 OR perimeter_m <= 0 OR length_m <= 0 OR width_m <= 0").count() == 0
    assert vector.read_gpkg(spark, str(tmp_path / "out/layers.gpkg"), "parcels").count() == counts["parcels"]
    assert json.load(open(tmp_path / "out/summary.json"))["counts"] == counts
    assert vector.read_summary(spark, str(tmp_path / "out/summary.json")).first().counts.buildings == counts["buildings"]


def test_stored_layers_of_the_larger_scene(spark, tmp_path):
    """The 512-pixel scene: counts and measures of the four layers, files and report."""
    p, heard = scene.write_scene(spark, str(tmp_path), 512), []
    done = mapping.run(spark, p["ortho"], str(tmp_path / "out"), p["pegs"], p["dsm"], tile=256, overlap=32, progress=lambda *x: heard.append(x))
    s = done["summary"]
    assert s["counts"]["buildings"] == 5 and s["counts"]["land_use_polygons"] == 7 and s["counts"]["parcels"] == 5
    assert abs(s["metrics"]["total_building_footprint_sqm"] - 4529.74) < 0.01
    assert abs(s["metrics"]["total_road_network_km"] - 0.288) < 0.002 and abs(s["metrics"]["total_parcel_area_hectares"] - 0.874) < 0.01
    assert heard[0] == ("scoring", 0.0) and heard[-1] == ("done", 1.0)
    for name in ("buildings", "roads", "parcels", "land_use"):
        doc = json.load(open(tmp_path / f"out/{name}.geojson"))
        assert len(doc["features"]) == done["layers"][name].count()
        at = doc["features"][0]["geometry"]["coordinates"][0]
        lon, lat = at if name == "roads" else at[0]
        assert 76 < lon < 77 and 18 < lat < 19
    assert all(os.path.exists(x) for x in s["outputs"].values()) and "| Class |" in open(tmp_path / "out/report.md").read()


def test_confidence_is_of_the_filled_outline(spark):
    rows = [(r, c, 0.1 if 4 <= r < 8 and 4 <= c < 8 else 0.9) for r in range(12) for c in range(12)]
    rows += [(r, c, 0.0) for r in range(-3, 15) for c in range(-3, 15) if not (0 <= r < 12 and 0 <= c < 12)]
    got = vectorize.buildings(spark.createDataFrame(rows, "r int, c int, p double"), (1.0, 0.0, 0.0, 0.0, -1.0, 0.0)).collect()
    assert [r.confidence for r in got] == [0.811]


def test_tasks_and_missing_crs(spark, tmp_path, monkeypatch):
    with pytest.raises(ValueError):
        mapping.run(spark, __file__, tasks=("clouds",))
    with pytest.raises(ValueError):
        vector.read_pegs(spark, _pegs(tmp_path), 32643)
    assert vector.read_pegs(spark, _pegs(tmp_path), 4326).count() == 1


def _pegs(folder):
    path = str(folder / "pegs.csv")
    with open(path, "w") as f:
        f.write("lon,lat\n76.0,18.0\n")
    return path


def test_missing_raster(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        mapping.run(spark, os.path.join(tmp_path, "none.tif"))
    with pytest.raises(SystemExit):
        cli.main([])
