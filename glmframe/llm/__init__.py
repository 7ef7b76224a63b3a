"""Training-data operators: quality, deduplication, tokenising, packing.

Each module holds one operator; ``queries`` registers one query per operator
and ``corpus_pipeline`` (repository top) chains five of them. Nothing else in
the library imports this subpackage.
"""
