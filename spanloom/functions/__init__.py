"""Column functions: text, similarity, and the lexicons they are given."""
