"""SQL for another engine that states each query's result independently of the Spark jobs."""
