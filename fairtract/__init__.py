"""Census-tract analytics as plain DataFrame functions on Spark."""
