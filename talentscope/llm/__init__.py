"""Training-data operators: token counts, language identification, packing,
quality rules, secret scans, importance resampling, near-duplicate join,
toxicity, byte-level BPE and exact top-k search.

Each module holds one operator with its own general interface; ``queries``
registers the ``opN_`` queries and ``oracle`` the SQL beside them.
"""
