"""Operators for large text corpora: token counts, packing, deduplication, fingerprints, encoding, quality.

Nothing else in the library imports this subpackage.  Every operator is a function from DataFrames to a DataFrame;
``queries`` holds the thin registered queries.
"""
