"""Analytics over versioned key-value logs, on Spark DataFrames."""
