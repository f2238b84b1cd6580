"""Training-data operators: mixing, BPE, URL filters, token counts, dedup, extraction, classifiers, joins, search."""
