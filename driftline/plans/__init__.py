"""Queries over the test tables: each operator on a proxy of its real input, with the SQL that says what it returns."""
