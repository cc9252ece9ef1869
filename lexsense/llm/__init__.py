"""Training-data operators: deduplication, quality, language, toxicity, tokenisation, packing.

Nothing else in the library imports this subpackage.
"""
