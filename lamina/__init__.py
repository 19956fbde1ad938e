"""Analytics on layered spatial data, as Spark jobs over plain DataFrames."""
