"""Training-data operators: filters, dedup, decontamination, sharding, chat and token formats.

Nothing outside this folder imports it; it can be removed without touching the rest of the library.
"""
