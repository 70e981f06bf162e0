"""Spark-native analytics for corpora of articulated 3-D assets and their runs."""
