"""Readers that turn evidence files and raw tables into DataFrames."""
