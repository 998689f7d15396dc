"""Reading and writing panels and market data."""
