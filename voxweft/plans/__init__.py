"""Queries over the tables, with their SQL, and the command line."""
