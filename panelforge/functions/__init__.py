"""Column builders: the algebra of time-series and cross-sectional functions."""
