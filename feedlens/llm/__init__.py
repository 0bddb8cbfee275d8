"""Training-data operators: search, cleaning, de-duplication, tokens, archives, packing."""
