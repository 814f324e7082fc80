"""Scalar functions, array kernels and the Arrow functions built on them."""
