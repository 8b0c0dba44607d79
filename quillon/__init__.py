"""A PySpark-native analytics engine: declarative operators on DataFrames, SQL and Structured Streaming."""
