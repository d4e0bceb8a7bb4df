"""operators of the archive inventory engine."""
