"""Relational operators over entries, candidates and edges."""
