"""Prime-set analytics on Spark."""
