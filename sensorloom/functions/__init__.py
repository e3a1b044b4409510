"""Column functions: cleaning, keys, arrays, signal kernels, text."""
