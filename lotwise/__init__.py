"""A Spark-first listing-intelligence engine."""
