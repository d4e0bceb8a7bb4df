"""functions of the archive inventory engine."""
