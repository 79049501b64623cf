"""Relational operators over property graphs, vectors and documents."""
