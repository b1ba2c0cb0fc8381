"""Scalar building blocks, all plain Column expressions unless stated otherwise."""
