"""Column functions: units, number formats, scalar solvers, random distributions."""
