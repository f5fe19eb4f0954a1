"""Domain tables, the query catalogue and the job list."""
