"""Writers: CSV tables, JSON-LD, Cypher scripts, stage checkpoints."""
