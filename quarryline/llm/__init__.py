"""Operators that prepare text and code for language-model training.  Nothing else in the library imports this."""
