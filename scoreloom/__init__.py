"""scoreloom: evaluation analytics over large batches of model-written answers, on Spark DataFrames."""
