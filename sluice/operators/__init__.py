"""Operators composed of DataFrame operations."""
