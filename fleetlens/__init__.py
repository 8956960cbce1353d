"""Fleet analytics on Spark: facts, drift, policy, tags and scores for a whole
fleet of source repositories, as DataFrame and Structured Streaming jobs."""
