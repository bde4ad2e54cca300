"""Market-series analytics on Spark DataFrames: bars, quality, features, signals, ledgers and logs."""
