"""twinfold: duplicate elimination and fingerprinting on Spark DataFrames."""
