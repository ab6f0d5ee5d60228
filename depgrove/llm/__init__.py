"""Training-data operators: scoring, deduplication, fingerprints, chat formatting,
secret scans, language identification, mixing, packing, periodic runs and exact search
over vectors and words.

Nothing outside this subpackage imports it.  Every module holds one operator with
a general interface; ``queries`` derives the registered result columns from them.
"""
