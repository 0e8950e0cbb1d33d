"""keyloom: partition-lifecycle analytics on Spark DataFrames."""
