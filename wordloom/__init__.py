"""Word segmentation of unspaced text, and what belongs to it, on Spark DataFrames."""
