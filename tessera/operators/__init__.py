"""Operators over DataFrames; every function is lazy unless its docstring says iterative."""
