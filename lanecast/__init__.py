"""Order lead-time analytics and training-text operators as Spark DataFrame jobs."""
