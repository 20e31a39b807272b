"""Analytics over directed weighted graphs held as DataFrames."""
