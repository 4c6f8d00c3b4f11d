"""Model pipelines on Spark ML."""
