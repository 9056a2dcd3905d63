"""Tesserae: a Spark-native analytics engine for tiled images, detections and cells."""

__version__ = "0.1.0"
