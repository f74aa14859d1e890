"""Operators: pure DataFrame -> DataFrame transforms."""
