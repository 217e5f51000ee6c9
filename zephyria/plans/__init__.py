"""Composite jobs: chains of operators from scan to sink."""
