"""Column functions: text cleaning, similarity, quality points, confidence and keys."""
