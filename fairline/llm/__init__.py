"""Training-data operators: fingerprints, tokens, scores, filters and near-duplicate search."""
