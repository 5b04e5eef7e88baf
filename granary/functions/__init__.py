"""Column functions: text normalisation, similarity, scalar helpers."""
