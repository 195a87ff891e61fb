"""Operators for preparing training text: sharding, de-duplication, scoring, packing, scans and encoding.

Nothing else in the library imports this subpackage. Each operator takes a DataFrame and names of its columns, selects
only those (so further columns, also of clashing names, do no harm) and returns a new DataFrame.
"""
