"""Operators for text and event data that nothing else in the library imports."""
