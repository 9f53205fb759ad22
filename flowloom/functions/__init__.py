"""Scalar building blocks, all of them Catalyst expressions unless a docstring says otherwise."""
