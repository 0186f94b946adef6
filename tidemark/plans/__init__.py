"""Bindings of the operators to the given tables, and their SQL oracles."""
