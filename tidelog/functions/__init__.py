"""Column libraries: levels, times, arithmetic, text."""
