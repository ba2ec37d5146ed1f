"""Training-data operators: sharding, deduplication, packing, decontamination, scoring.

Nothing outside this subpackage imports it.
"""
