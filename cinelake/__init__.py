"""Archive inventory and training-corpus preparation as Spark query plans."""
