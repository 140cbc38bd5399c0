"""Spark analytics for state-space models of time series, and operators for training data."""
