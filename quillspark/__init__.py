"""quillspark: knowledge-base analytics and text processing on Spark DataFrames."""
