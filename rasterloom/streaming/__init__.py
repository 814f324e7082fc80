"""Continuous ingestion of raster files."""
