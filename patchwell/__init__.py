"""Region-of-interest patch extraction over stacked image slices, on Spark DataFrames."""
