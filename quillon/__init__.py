"""Numerical analytics on DataFrames: tabulated functions, sparse algebra, networks, units and more."""
