"""Training-data operators: deduplication, decontamination, packing, extraction and archive formats.

Nothing outside this subpackage imports it.
"""
