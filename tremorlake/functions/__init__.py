"""Column functions: time, geometry, labels, counter hashes, distributions."""
