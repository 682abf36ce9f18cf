"""Column functions: parsing, guarded arithmetic, dates and bands."""
