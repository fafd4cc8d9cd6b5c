"""Operators for preparing training data: URL filters, language-model and
toxicity scores, near-duplicate detection, quality rules, packing, repeated
passages, benchmark decontamination and license scans.

Nothing else in the library imports this package. Every operator takes
DataFrames and column names and returns a DataFrame; ``queries`` holds the
registered ``opN_*`` queries.
"""
