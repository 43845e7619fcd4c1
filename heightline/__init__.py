"""Spark-native analytics over height-indexed ledgers and event logs."""
