"""Relational, graph and model operators."""
