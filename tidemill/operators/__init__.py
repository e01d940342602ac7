"""Relational operators over plain and weighted DataFrames."""
