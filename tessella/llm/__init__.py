"""Training-data operators: packing, filtering, tokenising, archives, search and deduplication.

Nothing else in the library imports this subpackage.
"""
