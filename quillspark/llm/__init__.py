"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it.  Each module holds one operator and
the thin ``opN_`` query that binds it to the test tables; ``registry`` gathers
the queries.
"""
