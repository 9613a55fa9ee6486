"""Numpy kernels that run inside Arrow batches: one signal or matrix at a time."""
