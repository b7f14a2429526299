"""Operators on DataFrames of page records, links, images and layouts."""
