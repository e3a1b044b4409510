"""DataFrame operators: segments and windows, alignment joins, sampling, parsing, metrics."""
