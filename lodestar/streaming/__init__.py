"""Structured Streaming twins of the step kernels."""
