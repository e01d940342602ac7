"""Targets that hold a program's relation."""
