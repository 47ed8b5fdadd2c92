"""Operators of a training-data pipeline: filters, deduplication, tokens, packing, search.

Self-contained: the rest of the library never imports this subpackage.  The
modules keep general interfaces; ``queries`` binds them to the tables.
"""
