"""Filters, sequence validation, offset algebra, transformations and read-model handlers."""
