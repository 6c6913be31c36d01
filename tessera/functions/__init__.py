"""Column expressions: text, dates, numbers, presentation."""
