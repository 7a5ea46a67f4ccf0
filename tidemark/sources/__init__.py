"""Journals, state tables, message logs and offset tables as DataFrames."""
