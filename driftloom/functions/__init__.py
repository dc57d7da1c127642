"""Scalar functions, equations as expressions, and distribution tails."""
