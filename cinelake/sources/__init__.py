"""sources of the archive inventory engine."""
