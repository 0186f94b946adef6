"""DataFrame -> DataFrame operators, grouped by family (see README)."""
