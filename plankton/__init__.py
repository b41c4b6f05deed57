"""plankton: relational operators with exact nullability and row rules, as Spark DataFrame functions."""
