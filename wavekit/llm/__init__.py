"""Operators for large-scale training-data pipelines (deduplication, filtering, mixing, tokenising).

One module per operator; ``queries`` registers the ``opN_*`` queries. Nothing else in the library imports
this subpackage.
"""
