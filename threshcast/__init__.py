"""Threshold-exceedance forecasting on site-by-time tables, written for Spark DataFrames."""
