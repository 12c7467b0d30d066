"""Training-data operators: packing, near-duplicate search, tokenization, classifiers.

Nothing outside this subpackage imports it. ``registry`` lists its queries.
"""
