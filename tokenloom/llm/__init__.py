"""Training-data operators: language, dedup, mixing, quality, scoring, extraction, licences, tokens.

Nothing else in the library imports this subpackage.
"""
