"""Product-page data to import-ready catalogue tables, as Spark DataFrames."""
