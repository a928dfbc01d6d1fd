"""driftline: analytics for time-ordered sensor data on Spark."""

__version__ = "0.1.0"
