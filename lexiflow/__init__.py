"""Lexicon search and review scheduling on Spark."""
