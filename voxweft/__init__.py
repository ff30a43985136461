"""Speech-hypothesis analytics on Spark."""
