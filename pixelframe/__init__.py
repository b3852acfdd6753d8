"""Analytics and bulk processing over image collections as Spark DataFrames."""
