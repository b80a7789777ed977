"""Collects the registered queries of every plan module."""

from landgrid.plans import raster_queries, reports, vector_queries
from landgrid.registry import Registry

REGISTRY = Registry()
for module in (raster_queries, vector_queries, reports):
    for name, f in module.REGISTRY.queries.items():
        REGISTRY.add(name, module.REGISTRY.oracle.get(name))(f)
