"""Micro-batch and stateful entry points."""
