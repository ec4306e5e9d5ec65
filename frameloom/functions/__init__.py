"""Column expressions and small numpy kernels for binary parsing."""
