"""Training-data operators: near-duplicate search, packing, WARC, BPE, fingerprints, toxicity, chats, licences.

Nothing else in the library imports this subpackage.
"""
