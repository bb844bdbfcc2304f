"""Column expressions and grouped numeric kernels."""
