"""Training-data operators: deduplication, decontamination, filters, mixing and sharding.

Nothing else in the library imports this subpackage.
"""
