"""Column expressions and table helpers that the operators share."""
