"""Station time-series preparation as Spark jobs."""
