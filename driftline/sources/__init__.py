"""Readers and writers for record tables, lookup tables, grids and polygons."""
