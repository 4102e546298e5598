"""lacuna: rough-set analytics over incomplete tables, as Spark DataFrame jobs."""

from lacuna.plans.end_to_end import (  # noqa: F401
    aggregate,
    approximate,
    approximate_families,
    classes,
    estimate_possible,
    status,
    summary,
)
