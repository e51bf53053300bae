"""Fleet-scale static security audit on Spark."""
