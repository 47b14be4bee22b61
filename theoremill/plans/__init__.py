"""Projection of the tables, registered queries, their SQL, scratch tables."""
