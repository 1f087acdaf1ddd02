"""Queries over the fixture tables and their SQL twins."""
