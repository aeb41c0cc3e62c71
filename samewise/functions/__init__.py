"""Column functions: normalisation, similarity scores, sanitising."""
