"""Column expressions: portable random draws, generalisation, dates."""
