"""Spark-native point-cloud and raster analytics."""
