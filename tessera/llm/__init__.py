"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface and the thin ``opN`` query that derives the digest
columns from the operator's own output.
"""
