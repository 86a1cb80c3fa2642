"""Operators on graphs: transforms, models, worlds, diffusion, selection, minimization, reliability, sparsification."""
