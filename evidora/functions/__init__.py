"""Column functions: vectors, text, scores and windows."""
