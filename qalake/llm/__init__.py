"""Training-data operators: packing, decontamination, similarity joins, scans,
language ID, token counts, nearest neighbours and substring dedup.

Nothing else in the library imports this subpackage.
"""
