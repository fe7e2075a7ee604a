"""Which view definitions can be kept current."""
