"""Spark-native LiDAR elevation maps, spatial operators and map evaluation."""
