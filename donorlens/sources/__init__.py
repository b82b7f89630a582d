"""Reading delimited exports, tables and views; writing tables."""
