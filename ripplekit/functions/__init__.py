"""Kernels on numpy arrays, aggregates and statistics."""
