"""Column functions: text, urls, times."""
