"""Column functions: text, paths, times, sizes and flags."""
