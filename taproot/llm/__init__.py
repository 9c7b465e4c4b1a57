"""Training-data operators: formatting, similarity joins, filters, scans and mixing.

Nothing else in ``taproot`` imports this subpackage.
"""
