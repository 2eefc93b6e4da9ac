"""operators of the factor engine."""
