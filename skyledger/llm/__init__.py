"""Training-data operators: dedup, filtering, tokenising and archive formats for text corpora.

Nothing else in the library imports this subpackage.
"""
