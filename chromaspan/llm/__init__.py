"""Training-data operators: token counts, scoring, deduplication, classification, search and packing."""
