"""streaming of the factor engine."""
