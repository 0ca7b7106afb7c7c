"""An engine that audits quantitative research, on Spark DataFrames."""
