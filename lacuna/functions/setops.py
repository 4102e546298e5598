"""Column expressions on small sets held as ``array<bigint>``.

For sets already rendered into one value (codec input, small results).
Large sets stay in long form and use ``lacuna.operators.sets``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def set_union(a, b) -> Column:
    """SET-1: sorted union."""
    return F.array_sort(F.array_union(_c(a), _c(b)))


def set_intersect(a, b) -> Column:
    """SET-2: sorted intersection (inputs need not be sorted)."""
    return F.array_sort(F.array_intersect(_c(a), _c(b)))


def set_contains(a, b) -> Column:
    """SET-5: ``a ⊇ b``; an empty ``b`` is contained in everything."""
    return F.size(F.array_except(_c(b), _c(a))) == 0


def set_in_family(s, fam) -> Column:
    """SET-4: is set ``s`` (array) one of the sets of ``fam`` (array of arrays)?"""
    return F.array_contains(F.transform(_c(fam), lambda x: F.array_sort(x)), F.array_sort(_c(s)))


def set_intersect_all(fam) -> Column:
    """SET-3: intersection of all sets of ``fam`` (array of arrays)."""
    f = _c(fam)
    return F.array_sort(F.aggregate(f, F.element_at(f, 1), lambda acc, x: F.array_intersect(acc, x)))
