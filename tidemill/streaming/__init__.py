"""Durable state and the micro-batch runtime."""
