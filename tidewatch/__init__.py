"""tidewatch: metric monitoring and corpus preparation as Spark DataFrame jobs."""
