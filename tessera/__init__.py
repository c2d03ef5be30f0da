"""Analytics over source-code repositories, expressed with Spark DataFrames."""
