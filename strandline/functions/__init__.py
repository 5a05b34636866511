"""Shared building blocks: staging, graphs, windows and kernels."""
