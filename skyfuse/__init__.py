"""Object-space detection fusion and evaluation on Spark."""
