"""Training-data operators: filters, extraction, dedup, decontamination, packing.

Nothing else in the library imports this package; it may be removed whole.
"""
