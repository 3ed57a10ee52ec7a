"""Operators for building training corpora from web-scale text.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general interface; ``queries`` derives the registered
``opN_*`` queries from them.
"""
