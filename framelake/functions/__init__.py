"""Column functions: text, geometry and vectors. All are expressions, none a Python UDF."""
