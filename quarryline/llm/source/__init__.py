"""Grammars of source files."""
