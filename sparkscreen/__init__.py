"""A Spark-native equity screening engine."""
