"""Scalar functions: column expressions first, Arrow functions where iteration is needed."""
