"""Delta algebra."""
