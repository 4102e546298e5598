"""Column-expression codec for the text forms of sets and families.

Formats (fixed values of the interchange format):
    set      ids joined by ','            e.g. ``1,2,7``
    family   sets joined by '|'           e.g. ``1,2|4,7|7``
    pair     key and payload joined by a tab

Decoding is per row (split / transform / explode) and scales with the
input.  Encoding gathers ids: one value per set by default, as the
interchange format has it.  ``width`` cuts a set into numbered parts of at
most that many consecutive id values (``obj div width``); the part number is
a column of its own, and readers join parts by key and set id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the interchange format: id, set and field separators.
ID_SEP = ","
SET_SEP = "|"
FIELD_SEP = "\t"
EMPTY_FAMILY = "not_exist"

# White space that is trimmed around lines, keys and ids.
_OUTER = " \t\r\n\x0b\x0c"


def trimmed(c: Column) -> Column:
    """``c`` without outer white space of any kind (``trim`` removes spaces only)."""
    return F.btrim(c, F.lit(_OUTER))


def split_cells(line: Column | str, sep: str = ID_SEP) -> Column:
    """Split keeping empty trailing cells (``split(x, sep, -1)``)."""
    c = F.col(line) if isinstance(line, str) else line
    return F.split(c, _regex(sep), -1)


def _regex(sep: str) -> str:
    return "".join("\\" + ch if ch in ".|*+?()[]{}^$\\" else ch for ch in sep)


def decode_ids(s: Column | str) -> Column:
    """``'1,2,3'`` -> ``array<bigint>``; blank -> empty array."""
    c = trimmed(F.col(s) if isinstance(s, str) else s)
    parts = F.split(c, _regex(ID_SEP), -1)
    ids = F.transform(parts, lambda x: trimmed(x).cast("bigint"))
    return F.when(c == F.lit(""), F.array().cast("array<bigint>")).otherwise(ids)


def decode_family(s: Column | str) -> Column:
    """``'1,2|3'`` -> ``array<array<bigint>>`` (blank sets kept as empty arrays)."""
    c = F.col(s) if isinstance(s, str) else s
    return F.transform(F.split(c, _regex(SET_SEP), -1), lambda x: decode_ids(x))


def encode_ids(ids: Column) -> Column:
    """``array<bigint>`` -> ``'1,2,3'`` in ascending order."""
    return F.array_join(F.transform(F.array_sort(ids), lambda x: x.cast("string")), ID_SEP)


def encode_family(sets: Column) -> Column:
    """``array<array<bigint>>`` -> ``'1,2|3'`` (sets kept in the given order)."""
    return F.array_join(F.transform(sets, lambda a: encode_ids(a)), SET_SEP)


def encode_sets(long_df: DataFrame, keys: list[str], obj: str = "obj", width: int | None = None) -> DataFrame:
    """Long memberships -> ``(keys..., part, ids)``: one row per set, or per part of ``width`` id values."""
    part = (F.lit(0) if width is None else F.floor(F.col(obj) / F.lit(width))).cast("bigint").alias("part")
    return (long_df.groupBy(*keys, part)
            .agg(encode_ids(F.collect_set(F.col(obj).cast("bigint"))).alias("ids")))


def explode_ids(df: DataFrame, col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Rows of encoded sets -> one row per id (``obj``)."""
    keep = keep if keep is not None else [c for c in df.columns if c != col]
    return df.select(*keep, F.explode(decode_ids(col)).alias("obj"))


def explode_family(df: DataFrame, col: str, keep: list[str]) -> DataFrame:
    """Rows holding a family string -> ``(keep..., set_no, obj)``; blank sets vanish.

    The status ``not_exist`` in place of a family is the empty family.
    """
    df = df.where(trimmed(F.col(col)) != F.lit(EMPTY_FAMILY))
    sets = df.select(*keep, F.posexplode(F.split(F.col(col), _regex(SET_SEP), -1)).alias("set_no", "s"))
    return sets.select(*keep, "set_no", F.explode(decode_ids("s")).alias("obj"))


def parse_attribute_list(spec: str) -> list[int]:
    """SCL-5: ``'1,10,12'`` -> ``[1, 10, 12]`` (1-based attribute ordinals)."""
    return [int(x) for x in spec.replace(" ", "").split(ID_SEP) if x]
