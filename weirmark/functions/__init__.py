"""Column-level building blocks: addresses, code names, time slots."""
