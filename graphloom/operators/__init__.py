"""Relational and sequential operators over the knowledge graph and annotated text."""
