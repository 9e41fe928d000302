"""Readers and writers of nested clinical records and of saved runs."""
