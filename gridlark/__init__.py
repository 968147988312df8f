"""gridlark: evaluation analytics on dense two-axis grids, on Spark DataFrames."""
