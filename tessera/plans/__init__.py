"""Analytical queries, composed of operators, each with its SQL."""
