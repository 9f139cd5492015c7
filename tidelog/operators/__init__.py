"""Analytic operators; each takes a LogFrame or DataFrames and returns a DataFrame."""
