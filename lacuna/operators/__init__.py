"""DataFrame operators: per-attribute classes, long-form set algebra, minA/maxA aggregation, approximations."""
