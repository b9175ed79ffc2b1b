"""Spark-native land-cover and discrete-global-grid analytics."""
