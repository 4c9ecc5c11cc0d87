"""Relational operators over typed metric and catalog DataFrames."""
