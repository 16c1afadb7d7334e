"""Requests and plans given as plain dictionaries, turned into DataFrames."""
