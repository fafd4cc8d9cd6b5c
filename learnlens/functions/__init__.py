"""Column expressions: calendar projections, scores, rules, text."""
