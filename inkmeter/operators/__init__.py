"""Measures and findings over document tables (DataFrame in, DataFrame out)."""
