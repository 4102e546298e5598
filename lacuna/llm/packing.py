"""Best-fit packing of token pieces into fixed-length sequences, in bulk-synchronous supersteps.

Lengths and gaps are integers up to the capacity, so range-sorted documents and gaps form at most ``capacity`` runs of
equal keys.  In a superstep the longest pending run of pieces sweeps to its successor, the smallest gap that holds it;
pieces and gaps that meet there are matched by rank, the gaps shrink, and the step repeats.  Only where no gap is left
does a run open new sequences.  The sweep needs run lengths alone (a histogram of at most ``capacity`` integers,
whatever the input).  It yields ranges ``(length, ranks) -> (sequences, offset)``, and the pieces, ranked in Spark, find
their place by a range join on their own length; the plan is sent to all tasks where its size allows, so that a length
that most pieces share is no hot key.

Equal lengths are interchangeable, so this is best-fit decreasing over all pieces.  Defined results: null text is the
empty document (its closing id alone); repeated rows are packed each; rows with one id share ``doc_id`` and keep their
own sequences; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import fresh
from .session import ship, stored
from .text import LOWER, prefix_sums, slices, span_hash, words
from .units import task_tokenizer

CAPACITY = 4096
SLICE = 1 << 18  # text bytes handled at once
ENCODED = 1000  # words encoded at once; the library's result for a word is some hundred times its length
PLAN_ROWS = 1 << 18  # a plan of up to so many rows (48 bytes each) is sent to all tasks; a longer one is joined by length
END_ID = 1
CACHE_WORDS = 1_500_000  # distinct words whose ids a Python worker remembers; beyond it the memory starts anew


_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True


class WordIds:
    """Token ids of words, each distinct one encoded once for each worker process.

    The vocabulary lower-cases, drops white space and never joins characters across it, nor a punctuation mark to a
    letter before it.  So a text's ids are the ids of its lower-cased words, cut there, one after another.  Texts that
    hold a special token's string are encoded whole by the caller.
    """

    def __init__(self, path: str):
        self.tokenizer = task_tokenizer(path)
        self.marks = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.start = np.zeros(0, dtype=np.int64)
        self.count = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def learn(self, keys: np.ndarray, strings: list[str]) -> None:
        if len(self.keys) + len(keys) > CACHE_WORDS:
            self.clear()
        found = []
        for at in range(0, len(strings), ENCODED):
            found += [e.ids for e in self.tokenizer.encode_batch(strings[at : at + ENCODED], add_special_tokens=False)]
        count = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        ids = np.fromiter((i for x in found for i in x), dtype=np.uint32, count=int(count.sum()))
        start = len(self.ids) + np.cumsum(count) - count
        keys, start, count = np.r_[self.keys, keys], np.r_[self.start, start], np.r_[self.count, count]
        order = np.argsort(keys, kind="stable")
        self.keys, self.start, self.count, self.ids = keys[order], start[order], count[order], np.r_[self.ids, ids]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, and each row's number of ids."""
        data = LOWER[data]
        first, last = words(data, offsets)
        cuts = np.flatnonzero(_LETTER[data[:-1]] & _MARK[data[1:]]) + 1
        cuts = cuts[~np.isin(cuts, offsets)]
        first, last = np.sort(np.r_[first, cuts]), np.sort(np.r_[last, cuts])
        hashes = span_hash(prefix_sums(data), first, last)
        keys, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), dtype=bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        if new.any():
            if len(self.keys) + int(new.sum()) > CACHE_WORDS:
                self.clear()
                new[:] = True
            raw = data.tobytes()
            self.learn(keys[new], [raw[first[i] : last[i]].decode() for i in where[new]])
            at = np.searchsorted(self.keys, keys)
        count = self.count[at][back]
        to = np.cumsum(count)
        ids = self.ids[np.repeat(self.start[at][back] - (to - count), count) + np.arange(int(to[-1]) if len(to) else 0)]
        ends = np.r_[0, to][np.searchsorted(first, offsets)]
        return ids, np.diff(ends)


_known: dict[str, WordIds] = {}


def _word_ids(path: str) -> WordIds:
    if path not in _known:
        _known[path] = WordIds(path)
    return _known[path]


def _pieces(path: str, text: str, keep: list[str], capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _word_ids(path)
        for batch in batches:
            for rows, data, offsets in slices(batch, text, SLICE):
                ids, counts = model.encode(data, offsets)
                cut = np.r_[0, np.cumsum(counts)]
                raw = data.tobytes()
                special = any(m in raw for m in model.marks)
                out: list[tuple[int, int, int, int, int]] = []
                for k in range(rows.num_rows):
                    own = ids[cut[k] : cut[k + 1]]
                    if special:
                        body = raw[offsets[k] : offsets[k + 1]]
                        if any(m in body for m in model.marks):
                            own = np.array(model.tokenizer.encode(body.decode(), add_special_tokens=False).ids, dtype=np.uint32)
                    own = np.append(own, np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(own), capacity)):
                        part = own[start : start + capacity]
                        out.append((k, piece, start, len(part), zlib.crc32(part.tobytes())))
                made = np.array(out, dtype=np.int64).reshape(-1, 5)
                take = pa.array(made[:, 0])
                yield pa.record_batch(
                    [rows.column(rows.schema.get_field_index(c)).take(take) for c in keep]
                    + [pa.array(made[:, 1].astype(np.int32)), *(pa.array(made[:, j]) for j in (2, 3, 4))],
                    names=[*keep, "piece", "start", "length", "ids_crc32"],
                )

    return run


def token_pieces(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text",
                 capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: the document's ids and a closing id, cut every ``capacity`` ids."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("piece", T.IntegerType()),
                           *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))])
    return rows.mapInArrow(_pieces(tokenizer, "_text", ["doc_id"], capacity, end_id), schema)


def sweep(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over runs of equal lengths: ``(length, first rank, last rank + 1, first sequence, offset, per)``.

    Rank ``r`` goes to sequence ``first sequence + (r - first rank) // per``, at ``offset`` plus ``length`` for each
    earlier rank there.  Gaps are kept as runs of neighbouring sequences with one gap.
    """
    gaps: list[int] = []  # sizes with an open run, ascending
    runs: dict[int, list[tuple[int, int]]] = {}  # gap -> [(first sequence, how many)]
    placed, opened = [], 0

    def add(gap: int, first: int, many: int) -> None:
        if gap and many:
            if gap not in runs:
                runs[gap] = []
                insort(gaps, gap)
            runs[gap].append((first, many))

    for length in sorted(counts, reverse=True):
        rank, many = 0, counts[length]
        while rank < many:
            k = bisect_left(gaps, length)
            if k == len(gaps):  # no successor: new sequences, each filled with this length as far as it goes
                per = min(capacity // length, many - rank)
                whole = (many - rank) // per
                placed.append((length, rank, rank + whole * per, opened, 0, per))
                add(capacity - per * length, opened, whole)
                opened, rank = opened + whole, rank + whole * per
                continue
            gap = gaps[k]
            first, there = runs[gap].pop()
            if not runs[gap]:
                del runs[gap], gaps[k]
            per = min(gap // length, many - rank)
            used = min(there, (many - rank) // per)
            placed.append((length, rank, rank + used * per, first, capacity - gap, per))
            add(gap - per * length, first, used)
            add(gap, first + used, there - used)
            rank += used * per
    return placed


def pack(pieces: DataFrame, *, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` added (named anew where ``pieces`` has such columns).

    Pieces must be no longer than ``capacity``; those of length 0 or null come back with null places.
    """
    cols, spark = pieces.columns, pieces.sparkSession
    # rank in the run of equal lengths: within each stored part, then shifted by what earlier parts hold
    held = stored(pieces.select(F.struct(*cols).alias("row"), F.col(length).cast("bigint").alias("n"), F.spark_partition_id().alias("part")), "pack-pieces")
    by_part = held.groupBy("n", "part").agg(F.count("*").alias("c"))
    shift = by_part.select(F.col("n").alias("sn"), F.col("part").alias("sp"), (F.sum("c").over(Window.partitionBy("n").orderBy("part")) - F.col("c")).alias("sb"))
    counts = {int(r[0]): int(r[1]) for r in held.where("n > 0").groupBy("n").count().collect()}  # at most `capacity` rows
    if counts and max(counts) > capacity:
        raise ValueError(f"a piece of {max(counts)} exceeds the capacity {capacity}")
    placed = sweep(counts, capacity)
    plan = spark.createDataFrame(placed, "l bigint, first bigint, past bigint, seq bigint, off bigint, per bigint")
    if len(placed) <= PLAN_ROWS:
        plan = F.broadcast(plan)
    # by content, so a part that is worked out again ranks alike; rows equal in all columns may change places
    known = [F.col("row").getField(f.name) for f in held.schema["row"].dataType.fields if isinstance(f.dataType, T.AtomicType)]
    local = F.row_number().over(Window.partitionBy("n", "part").orderBy(F.xxhash64(*known), *known)) - 1
    ranked = held.withColumn("rank", local).join(shift, F.col("n").eqNullSafe(F.col("sn")) & (F.col("part") == F.col("sp")), "left")
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("sb"))
    found = ranked.join(plan, (F.col("n") == F.col("l")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("past")), "left")
    nth = F.col("rank") - F.col("first")
    sequence = (F.col("seq") + F.floor(nth / F.col("per"))).cast("bigint")
    offset = (F.col("off") + (nth % F.col("per")) * F.col("n")).cast("bigint")
    return found.select("row.*", sequence.alias(fresh("sequence_id", cols)), offset.alias(fresh("offset", cols)))
