"""Scalar kernels."""
