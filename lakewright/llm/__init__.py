"""Training-data operators: token counts, quotation linking, near duplicates,
language, BPE, personal data, packing, embeddings, toxicity and media columns.

Nothing outside this package imports it.
"""
