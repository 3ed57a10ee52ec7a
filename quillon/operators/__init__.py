"""Operators over DataFrames: tables, matrices, networks, fluids, lookups, plots, voxels."""
