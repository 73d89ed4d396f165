"""Corpus operators for large training sets; nothing else in the library imports this subpackage."""
