"""Array stores and tables as grids."""
