"""The same work on Structured Streaming sources."""
