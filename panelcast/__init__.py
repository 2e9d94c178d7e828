"""Spark operators for forecasting panels of entities observed over ordered periods."""
