"""plans of the factor engine."""
