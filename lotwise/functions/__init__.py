"""Column functions: native expressions only, no Python in the data path."""
