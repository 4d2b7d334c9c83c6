"""What to run: the report filter, the registered queries and their checks."""
