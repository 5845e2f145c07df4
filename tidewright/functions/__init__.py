"""Column expressions: time, order-preserving keys, portable random numbers."""
