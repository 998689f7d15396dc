"""Operators over panels: assembly, factors, information coefficients, portfolios, validation."""
