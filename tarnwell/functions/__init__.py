"""Column functions and domain lexicons."""
