"""Panel-load analytics on Spark."""
