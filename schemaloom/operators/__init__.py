"""Operators over the metadata model and over data rows. All take and return DataFrames."""
