"""A Spark-native analytics engine for log and event data."""
