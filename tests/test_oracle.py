"""Every registered query with oracle SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from landgrid.plans.catalog import REGISTRY
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(REGISTRY.oracle))
def test_query_equals_its_oracle(spark, name):
    n, why = compare(spark, SF, REGISTRY.queries[name], REGISTRY.oracle[name])
    assert n >= 0 and not why


@pytest.mark.parametrize("name", sorted(set(REGISTRY.queries) - set(REGISTRY.oracle)))
def test_query_has_rows(spark, name):
    assert REGISTRY.queries[name](spark, SF).count() > 0


def test_voronoi_cells_are_of_all_suppliers(spark):
    from landgrid.plans.views import points

    for sf in (SF, "/root/testdata/sf0.1"):
        areas = [r.area for r in REGISTRY.queries["voronoi_cells"](spark, sf).collect()]
        assert len(areas) == points(spark, sf, "supplier").select("x", "y").distinct().count() > 8 and abs(sum(areas) - 250_000) < 5


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
