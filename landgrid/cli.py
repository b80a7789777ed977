"""Command line: ``python -m landgrid.cli --ortho a.tif --out folder`` or ``--generate-sample folder``."""

from __future__ import annotations

import argparse
import json
import sys


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="landgrid")
    p.add_argument("--ortho")
    p.add_argument("--pegs")
    p.add_argument("--dsm")
    p.add_argument("--dtm")
    p.add_argument("--out", default="landgrid-out")
    p.add_argument("--tile", type=int, default=512)
    p.add_argument("--overlap", type=int, default=64)
    p.add_argument("--min-building", type=float, default=15.0)
    p.add_argument("--min-parcel", type=float, default=80.0)
    p.add_argument("--tolerance", type=float, default=2.0)
    p.add_argument("--building-threshold", type=float, default=0.5)
    p.add_argument("--road-threshold", type=float, default=0.45)
    p.add_argument("--no-ortho", action="store_true", help="leave building corners as traced")
    p.add_argument("--tasks", default="buildings,roads,landuse", help="what is scored, separated by commas")
    p.add_argument("--compat", action="store_true", help="keep the documented deviations of the studied behaviour")
    p.add_argument("--generate-sample", metavar="FOLDER")
    p.add_argument("--size", type=int, default=1024)
    a = p.parse_args(argv)
    if not a.generate_sample and not a.ortho:
        p.error("--ortho or --generate-sample is needed")
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("landgrid").getOrCreate()
    if a.generate_sample:
        from landgrid.sources.scene import write_scene

        print(json.dumps(write_scene(spark, a.generate_sample, a.size), indent=2))
        return 0
    from landgrid.plans.mapping import run

    done = run(spark, a.ortho, a.out, a.pegs, a.dsm, a.dtm, a.tile, a.overlap, a.min_building, a.min_parcel, a.tolerance, a.compat, a.building_threshold, a.road_threshold, not a.no_ortho, tuple(a.tasks.split(",")), lambda stage, share: print(f"{share:4.0%} {stage}", file=sys.stderr))
    print(json.dumps(done["summary"], indent=2))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
