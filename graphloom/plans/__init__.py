"""Registered queries with their SQL, and the service facade."""
