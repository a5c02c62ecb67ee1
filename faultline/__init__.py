"""Change-impact analytics over source trees, histories and test suites, as Spark DataFrames."""
