"""End-to-end API, execution helpers (measured broadcast, hot-key split, lineage cuts), fixtures, oracle SQL, registry."""
