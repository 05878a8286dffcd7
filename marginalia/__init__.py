"""Journal-graph analytics and text data processing on PySpark DataFrames."""
