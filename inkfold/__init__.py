"""inkfold: text forensics over Spark DataFrames."""
