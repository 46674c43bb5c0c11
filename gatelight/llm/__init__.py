"""Corpus preparation for language-model training; nothing else in the package imports this."""
