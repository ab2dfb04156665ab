"""Operators for preparing training text at scale, one module each.

Nothing outside this package imports it, so it can be taken away as a whole. Every operator takes a
DataFrame and column names and returns a DataFrame; ``queries`` holds the registered ones.
"""
