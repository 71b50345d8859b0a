"""Book identifier analytics on Spark."""
