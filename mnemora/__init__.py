"""mnemora: a memory-graph analytics engine on Spark DataFrames."""
