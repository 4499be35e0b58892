"""Readers: text, ontologies, CSV tables, Cypher scripts, stage checkpoints."""
