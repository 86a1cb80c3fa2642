"""Readers and writers of graphs, seeds, results and linear programs."""
