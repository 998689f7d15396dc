"""Formulas, their compilation to DataFrame stages, and the search for new ones."""
