"""harborlight: marine point-of-interest analytics written for Spark DataFrames."""
