"""Association screening over long entity x feature matrices, on Spark DataFrames."""
