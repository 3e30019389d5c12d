"""Tesserae: a PySpark-native engine for tile, feature and corpus analytics."""
