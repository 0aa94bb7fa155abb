"""Column expressions, schema helpers and statistics shared by the operators."""
