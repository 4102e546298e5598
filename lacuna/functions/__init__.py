"""Column expressions: missing-value predicate, set stats and fingerprints, text codec, array set functions."""
