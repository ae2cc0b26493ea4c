"""Column functions: no actions, no Python UDFs, all inside whole-stage code generation."""
