"""Where log records come from."""
