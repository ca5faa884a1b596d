"""Operators for preparing training text: one module for each problem, p1 to p10."""
