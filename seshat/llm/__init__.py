"""Training-data operators: scoring, deduplication, decontamination and packing of documents.

Nothing else in the library imports this subpackage.
"""
