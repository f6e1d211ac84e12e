"""Registered queries and composed jobs."""
