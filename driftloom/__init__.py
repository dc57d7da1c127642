"""Time-series dynamics at panel scale on Spark."""
