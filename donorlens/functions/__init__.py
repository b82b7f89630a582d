"""Column expressions: period labels, ratios, customer segments."""
