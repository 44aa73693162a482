"""Sufficient statistics over streams."""
