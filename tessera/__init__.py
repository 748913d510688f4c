"""Time-series compression and queries over compressed series as Spark DataFrames."""
