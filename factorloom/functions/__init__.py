"""functions of the factor engine."""
