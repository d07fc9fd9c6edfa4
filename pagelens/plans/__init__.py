"""Derived views, registered queries and their oracle SQL."""
