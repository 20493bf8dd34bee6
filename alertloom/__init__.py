"""Alert correlation on Spark: logs in, ranked and scored incidents out."""
