"""Operators for building training corpora: extraction, filtering, deduplication, decontamination, encoding, sharding.

Nothing else in the library imports this package.  Every operator takes tables
with any further columns, reads only the ones it names, and returns new tables.
"""
