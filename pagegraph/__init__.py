"""A PySpark-native link-graph engine: from wiki dumps to shortest routes, with DataFrames all the way."""
