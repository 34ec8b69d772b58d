"""Training-data operators: language identification, near-duplicate search at
line, passage and document level, main-text extraction, sequence packing, URL
filters, archives, nearest neighbours and benchmark decontamination.

Nothing outside this subpackage imports it.
"""
