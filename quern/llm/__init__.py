"""Training-data operators: filtering, deduplication, scoring, packing and retrieval.

Nothing outside this subpackage imports it. ``queries`` holds the thin queries,
one module per operator holds the operator itself.
"""
