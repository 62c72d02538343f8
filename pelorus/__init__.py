"""Spark-native analytics over vessel position reports, radar scenes and their records."""
