"""Operators for preparing training corpora and searching vectors; nothing else in the library imports them."""
