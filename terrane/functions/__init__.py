"""Column functions: coordinates, statistics, sequences and strings."""
