"""Column functions, plus small Python helpers for values that stay on the driver."""
