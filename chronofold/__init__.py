"""Event-ledger analytics on Spark DataFrames: folds, bitemporal reads, graph and search operators."""
