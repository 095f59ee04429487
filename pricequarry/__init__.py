"""Spark-native analytics for supplier price lists."""
