"""Source-corpus risk analytics on Spark."""
