"""rasterloom: a PySpark-native engine for lossless raster data."""
