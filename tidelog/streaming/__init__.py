"""The same analyses over unbounded input."""
