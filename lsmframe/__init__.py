"""Log-structured key-value analytics as DataFrame queries."""
