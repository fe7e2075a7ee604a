"""Names and log positions."""
