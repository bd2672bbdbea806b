"""Training-data operators: deduplication, packing, token counts, privacy, quality, search.

Nothing outside this subpackage imports it.
"""
