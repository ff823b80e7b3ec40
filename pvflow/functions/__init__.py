"""Column functions: names, commands, nested values."""
