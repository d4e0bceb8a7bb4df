"""plans of the archive inventory engine."""
