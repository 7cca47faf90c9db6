"""Column expressions: they add no shuffle, stay in generated code and can be used in any plan."""
