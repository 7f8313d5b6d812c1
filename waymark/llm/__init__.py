"""Training-data operators: tokens, packing, decontamination, deduplication and filters.

Nothing else in the library imports this subpackage; ``queries`` registers its queries.
"""
