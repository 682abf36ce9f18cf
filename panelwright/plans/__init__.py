"""Query plans: the operators applied to the given tables."""
