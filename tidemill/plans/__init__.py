"""Logical plans, and their snapshot and changelog evaluation."""
