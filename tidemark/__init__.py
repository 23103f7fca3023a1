"""Spark-native analytics for many keyed series and many labelled vectors."""
