"""Operators: spatial joins, matching, reconciliation, topology, layers, sync, raster, relational reads."""
