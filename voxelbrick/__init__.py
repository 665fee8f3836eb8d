"""Volumetric image alignment on Spark: volumes as tables of bricks."""
