"""Column expressions: distances, quantisation, labels, text analysis, units."""
