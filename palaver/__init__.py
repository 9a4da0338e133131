"""Search, analytics, upkeep and export of conversation archives, as Spark jobs."""
