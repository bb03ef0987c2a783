"""qvault: cryptographic inventory and post-quantum risk analytics on Spark DataFrames."""
