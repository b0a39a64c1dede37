"""Spark-native table mirroring, partition refresh and row-secured reads."""
