"""Training-data operators: packing, quality, line dedup, mixing, URL filters, quality rules,
HTML extraction, near-duplicates, chat formatting, vector search, BPE, conversation repair and
Merkle manifests.

Nothing else in the library imports this subpackage; it imports general helpers only.
"""
