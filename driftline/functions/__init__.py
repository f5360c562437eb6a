"""Column functions: angles, geodesy, vectors and parsing, all inside Spark's generated code."""
