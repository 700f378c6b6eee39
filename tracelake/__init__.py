"""tracelake: analytics over append-only event transcripts, on Spark DataFrames."""
