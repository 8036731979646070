"""Queries over tables, and the entry points of the library."""
