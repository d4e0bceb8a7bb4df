"""Training-corpus operators. Nothing outside this folder imports it, save the guarded registration in __spark_entry__."""
