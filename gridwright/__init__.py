"""gridwright: distribution-grid analytics on Spark DataFrames."""
