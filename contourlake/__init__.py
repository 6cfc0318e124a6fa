"""Contour and time-frequency analytics on Spark tables."""
