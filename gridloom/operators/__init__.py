"""Operators over grids and tidy tables."""
