"""Readers and writers. All are lazy and distributed unless a docstring says otherwise."""
