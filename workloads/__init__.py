"""Registered queries: library operators over tables derived from the given ones."""
