"""Column expressions and per-batch array kernels."""
