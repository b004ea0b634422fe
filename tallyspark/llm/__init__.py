"""Training-data operators (text quality, dedup, search, packing, formats).

Nothing else in the library imports this subpackage.
"""
