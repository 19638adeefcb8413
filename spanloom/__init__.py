"""spanloom: message extraction analytics and corpus preparation on Spark."""
