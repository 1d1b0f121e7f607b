"""tarnweave: analytics over crawled web data on Spark DataFrames."""
