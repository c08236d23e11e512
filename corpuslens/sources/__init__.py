"""Readers that turn feeds, pages and files into DataFrames."""
