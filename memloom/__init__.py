"""A Spark-native engine for typed-graph text memories."""
