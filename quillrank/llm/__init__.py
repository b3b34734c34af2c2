"""Training-data operators: quality, quotes, digests, near copies, toxicity, pieces, surrogates, packing, licences."""
