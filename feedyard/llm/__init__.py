"""Operators of a training-data pipeline (near-dedup, extraction, scoring, mixing).

Nothing else in the package imports this folder; it uses only general helpers of
`feedyard.session`.  Each module holds one operator, `queries.py` the registered
queries and their SQL.
"""
