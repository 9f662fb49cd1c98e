"""Column functions: text normalisation, similarity, hashing."""
