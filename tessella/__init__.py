"""tessella: scoring, matching and text-provenance analytics on Spark DataFrames."""
