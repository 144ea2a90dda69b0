"""slateflow: context retrieval and source refresh on Spark DataFrames."""
