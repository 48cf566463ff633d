"""Column functions: Column in, Column out, no actions."""
