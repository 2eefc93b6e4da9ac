"""sources of the factor engine."""
