"""Operators over DataFrames; every module is one family."""
