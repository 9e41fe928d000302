"""Whole jobs over tables: the registered queries."""
