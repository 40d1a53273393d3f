"""Settings, and the comparison as one set of lazy DataFrames."""
