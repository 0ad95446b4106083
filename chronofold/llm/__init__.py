"""Training-data operators: deduplication, language, extraction, tokens, packing and binary output.

Nothing outside this folder imports it.  Each module holds one operator with a general interface;
``contracts`` holds the thin ``opN_`` queries and their SQL.
"""
