"""Registered queries: each one applies operators of this library to the tables of a folder."""
