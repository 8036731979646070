"""Operators for preparing training corpora.

Each module holds one operator; ``queries`` registers them.  Nothing outside
this package imports it.
"""
