"""Record assembly, stream capture and training-data operations on Spark DataFrames."""
