"""Column-level functions: built-in expressions only, so plans stay inside code generation."""
