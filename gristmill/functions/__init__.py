"""Column expressions: null rules, string predicates and text casts, aggregate functions, schemas."""
