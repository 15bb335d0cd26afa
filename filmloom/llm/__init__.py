"""Operators for preparing text corpora and their records; nothing else in the package imports from here."""
