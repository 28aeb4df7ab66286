"""Where records, summaries and dead letters go."""
