"""Column functions: everything row-local, all inside whole-stage code generation."""
