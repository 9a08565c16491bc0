"""Column helpers: text, network addresses, times, value forms."""
