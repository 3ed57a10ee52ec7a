"""Registered queries over the test tables, each with equivalent SQL."""
