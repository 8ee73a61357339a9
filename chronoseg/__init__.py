"""Spark-native temporal segmentation: ordered sequences to shots, scenes, events and chapters."""
