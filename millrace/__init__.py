"""Document and graph analytics on Spark."""
