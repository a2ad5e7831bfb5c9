"""Registered queries over the driver tables, with the SQL each one must match."""
