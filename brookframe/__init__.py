"""brookframe: relational, collection and document queries as plain Spark DataFrames."""
