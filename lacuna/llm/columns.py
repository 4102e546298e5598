"""Column helpers shared by the operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import per_row, slices, words


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores appended until it differs (in any case) from ``taken``."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def _count_words(texts: pa.Array) -> pa.Array:
    batch = pa.record_batch([texts], names=["t"])
    counts = [np.diff(per_row(words(data, offsets)[0], offsets)) for _, data, offsets in slices(batch, "t")]
    return pa.array(np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64), type=pa.int64())


def word_count(column: Column | str) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` of a text column (null: 0)."""
    return F.arrow_udf(_count_words, "bigint")(column)


def row_hash(column: Column | str) -> Column:
    """60 bits of the MD5 of an id's text (null: of ``null``): the same in any SQL engine, whatever the id's type."""
    c = F.col(column) if isinstance(column, str) else column
    return F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("bigint")


def learns(doc_id: Column | str, modulus: int, held: int) -> Column:
    """True for rows outside the held-out fold ``crc32(id as text) mod modulus = held`` (null id: of ``null``)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("null"))) % modulus != held
