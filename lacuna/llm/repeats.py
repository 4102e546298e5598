"""Exact removal of long repeated byte strings by bucket refinement over sampled suffixes.

Suffixes are put into initial q-gram buckets, and buckets that hold more than one suffix are refined by the identifiers
(64-bit content hashes) of longer pieces at later offsets, whose results the next level reuses, until every 400-byte
string is known to be repeated or not.  A full suffix array is eight bytes for each input byte, so only anchors are
kept: in every 400-byte string, the q-gram with the least hash (the first among equals).  That choice depends on the
string alone, so two equal strings have their anchors at the same place and meet in one bucket.  An anchor stands for
the run of strings that chose it, about 170 of them.

Level 0: an anchor alone in its bucket has no repeated string.  If the union of its run's bytes, seen from the anchor,
occurs elsewhere, all its strings are repeated.  Of the anchors left in a bucket, one for each distinct union goes on;
its run is cut into nodes of ``NODE`` offsets.  Level 1: a node whose core (the bytes that all its strings share) is
alone has no repeated string; a node whose union occurs elsewhere is repeated as a whole.  Level 2: single strings of
the nodes that are left.  Each level only counts equal identifiers with map-side sums, so neither a hot passage nor a
large group of copies is ever gathered or paired.

Defined results: null is the empty text; a text shorter than 400 bytes keeps all; each of two repeated rows removes the
other's strings and its own; a null id is an id of its own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import ship, stored
from .text import mix, powers, prefix_sums, signed, slices, span_hash
from .text import _INVERSE  # the hash's own constant

LENGTH = 400
GRAM = 64
NODE = 16
SLICE = 1 << 20


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every run of ``w`` neighbours, by running minima of blocks from both sides."""
    n = len(x)
    if n < w:
        return x[:0]
    blocks = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, dtype=x.dtype)
    blocks[:n] = x
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


class Anchors:
    """Anchors of a slice of texts: place, first and last string start of the run, row, number within the row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
        self.sums = prefix_sums(data)
        size = np.diff(offsets)
        full = size >= length
        none = np.zeros(0, dtype=np.int64)
        self.at = self.lo = self.hi = self.row = self.number = none
        self.grams = np.zeros(0, dtype=np.uint64)
        if not full.any():
            return
        m = len(data) - gram + 1
        self.grams = mix((self.sums[gram:] - self.sums[:-gram]) * powers(_INVERSE, m))
        key = (self.grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
        best = sliding_min(key, length - gram + 1)
        live = np.zeros(len(data) + 2, dtype=np.int64)
        np.add.at(live, offsets[:-1][full], 1)
        np.add.at(live, offsets[1:][full] - length + 1, -1)
        starts = np.flatnonzero(np.cumsum(live) > 0)
        at = (best[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        self.at, self.lo = at[first], starts[first]
        self.hi = starts[np.r_[first[1:], len(starts)] - 1]
        self.row = np.searchsorted(offsets, self.lo, side="right") - 1
        self.number = np.arange(len(first)) - np.searchsorted(self.row, self.row)

    def union(self, length: int) -> np.ndarray:
        """Identifier of the run's bytes as seen from the anchor."""
        shape = (self.at - self.lo).astype(np.uint64) << np.uint64(32) | (self.hi - self.lo).astype(np.uint64)
        return mix(span_hash(self.sums, self.lo, self.hi + length) + mix(shape))


def _level0(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text", SLICE):
                x = Anchors(data, offsets, length, gram)
                take = pa.array(x.row)
                yield pa.record_batch(
                    [rows.column(0).take(take), rows.column(1).take(take), pa.array(x.number.astype(np.int32)),
                     pa.array(signed(x.grams[x.at])), pa.array(signed(x.union(length)))],
                    names=["k1", "k2", "number", "bucket", "whole"],
                )

    return run


def _snippets(length: int, gram: int):
    """The bytes of the wanted anchors' runs, with the anchor's place and the run's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text", SLICE):
                x = Anchors(data, offsets, length, gram)
                first = np.searchsorted(x.row, np.arange(rows.num_rows))
                want = rows.column(rows.schema.get_field_index("numbers"))
                row = np.repeat(np.arange(rows.num_rows), pa.compute.list_value_length(want).to_numpy())
                k = first[row] + want.flatten().to_numpy()
                raw = data.tobytes()
                take = pa.array(row)
                yield pa.record_batch(
                    [rows.column(0).take(take), rows.column(1).take(take), pa.array((k - first[row]).astype(np.int32)),
                     pa.array([raw[a:b] for a, b in zip(x.lo[k], x.hi[k] + length)], type=pa.binary()),
                     pa.array((x.at[k] - x.lo[k]).astype(np.int32))],
                    names=["k1", "k2", "number", "body", "place"],
                )

    return run


def _bodies(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    bodies = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    _, raw, body = bodies.buffers()
    offsets = np.frombuffer(raw, dtype=np.int64)[bodies.offset : bodies.offset + len(bodies) + 1]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair, all integers from ``low`` to ``high``: which pair, and the integer."""
    many = high - low + 1
    of = np.repeat(np.arange(len(low)), many)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + low[of]


def _level1(length: int, node: int):
    """Nodes of ``node`` offsets ``x`` (from string start to anchor), cut to the run: core and union identifiers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                rows = batch.slice(a, 1024)
                data, offsets = _bodies(rows, "body")
                sums = prefix_sums(data)
                high = rows.column(rows.schema.get_field_index("place")).to_numpy().astype(np.int64)
                low = high - (np.diff(offsets) - length)
                of, j = _spread(low // node, high // node)
                x1, x2 = np.maximum(j * node, low[of]), np.minimum(j * node + node - 1, high[of])
                at = offsets[of] + high[of]
                core = span_hash(sums, at - j * node, at - j * node - node + 1 + length)
                whole = span_hash(sums, at - x2, at - x1 + length)
                take = pa.array(of)
                yield pa.record_batch(
                    [*(rows.column(c).take(take) for c in range(3)), pa.array(x1.astype(np.int32)), pa.array(x2.astype(np.int32)),
                     pa.array(signed(mix(core + mix(j.astype(np.uint64) + np.uint64(1))))),
                     pa.array(signed(mix(whole + mix((x1 << 32 | x2).astype(np.uint64)))))],
                    names=["k1", "k2", "number", "x1", "x2", "bucket", "whole"],
                )

    return run


def _level2(length: int):
    """Single strings of the nodes ``x1 .. x2``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                rows = batch.slice(a, 1024)
                data, offsets = _bodies(rows, "body")
                sums = prefix_sums(data)
                place, x1, x2 = (rows.column(rows.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("place", "x1", "x2"))
                of, x = _spread(x1, x2)
                at = offsets[of] + place[of] - x
                take = pa.array(of)
                yield pa.record_batch(
                    [*(rows.column(c).take(take) for c in range(3)), pa.array(x.astype(np.int32)),
                     pa.array(signed(mix(span_hash(sums, at, at + length) + mix(x.astype(np.uint64)))))],
                    names=["k1", "k2", "number", "x", "whole"],
                )

    return run


def _met(pieces: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Pieces by ``(bucket, whole)``: those whose whole is repeated, and one of each whole where a bucket has several.

    The second table also tells how often that whole occurs (``n``).
    """
    wholes = pieces.groupBy("bucket", "whole").agg(F.count("*").alias("n"), F.min(F.struct(*keys)).alias("one"))
    several = wholes.groupBy("bucket").agg(F.count("*").alias("_d")).where("_d > 1").select("bucket")
    left = wholes.join(several, "bucket", "left_semi").select("one.*", "n")
    again = pieces.join(wholes.where("n > 1").select("bucket", "whole"), ["bucket", "whole"], "left_semi")
    return again.select(*keys), left


def _cut(length: int, gram: int):
    """Digest columns of each text and its repeated ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text", SLICE):
                n = rows.num_rows
                found = rows.column(rows.schema.get_field_index("found"))
                row = np.repeat(np.arange(n), pa.compute.fill_null(pa.compute.list_value_length(found), 0).to_numpy())
                flat = found.flatten()
                live = np.zeros(len(data) + 2, dtype=np.int64)
                if len(flat):
                    x = Anchors(data, offsets, length, gram)
                    first = np.searchsorted(x.row, np.arange(n))
                    number, x1, x2 = (flat.field(c).to_numpy().astype(np.int64) for c in ("number", "x1", "x2"))
                    k = first[row] + number
                    start = np.where(x1 < 0, x.lo[k], x.at[k] - x2)
                    end = np.where(x1 < 0, x.hi[k], x.at[k] - x1) + length
                    np.add.at(live, start, 1)
                    np.add.at(live, end, -1)
                gone = np.cumsum(live)[: len(data)] > 0
                raw = data.tobytes()
                removed, spans, sha = [], [], []
                for r in range(n):
                    a, b = int(offsets[r]), int(offsets[r + 1])
                    g = gone[a:b]
                    many = int(g.sum())
                    body = data[a:b][~g].tobytes() if many else raw[a:b]
                    edge = np.flatnonzero(np.diff(np.r_[False, g, False].astype(np.int8))) if many else np.zeros(0, dtype=np.int64)
                    removed.append(many)
                    spans.append(edge.reshape(-1, 2).tolist())
                    sha.append(hashlib.sha256(body).hexdigest())
                yield pa.record_batch(
                    [rows.column(0), pa.array(np.diff(offsets)), pa.array(removed, type=pa.int64()),
                     pa.array(spans, type=pa.list_(pa.list_(pa.int64()))), pa.array(sha, type=pa.string())],
                    names=["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256"],
                )

    return run


def repeated_ranges(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, node: int = NODE) -> DataFrame:
    """``(k1, k2, found)``: for each text with repeated strings its anchors' repeated offsets (-1: the whole run).

    ``k1`` is the id (null: the least integer), ``k2`` a hash of the text; together they name rows that are alike.
    """
    texts = _named(docs, doc_id, text)
    keys = ["k1", "k2", "number"]
    anchors = stored(texts.select("k1", "k2", "text").mapInArrow(_level0(length, gram), "k1 bigint, k2 bigint, number int, bucket bigint, whole bigint"), "repeats-anchors")
    again, left = _met(anchors, keys)
    left = stored(left, "repeats-left")
    wanted = left.groupBy("k1", "k2").agg(F.collect_list("number").alias("numbers"))
    cut = texts.join(wanted.hint("shuffle_hash"), ["k1", "k2"]).select("k1", "k2", "text", "numbers")
    body = stored(cut.mapInArrow(_snippets(length, gram), "k1 bigint, k2 bigint, number int, body binary, place int").dropDuplicates(keys), "repeats-bodies")

    nodes = stored(body.mapInArrow(_level1(length, node), "k1 bigint, k2 bigint, number int, x1 int, x2 int, bucket bigint, whole bigint"), "repeats-nodes")
    node_again, node_left = _met(nodes, [*keys, "x1", "x2"])
    parts = node_left.join(body, keys)
    single = stored(parts.select(*keys, "x1", "x2", "body", "place").mapInArrow(_level2(length), "k1 bigint, k2 bigint, number int, x int, whole bigint"), "repeats-strings")
    twice = single.groupBy("whole").agg(F.count("*").alias("n")).where("n > 1").select("whole")
    one = single.join(twice, "whole", "left_semi").select(*keys, F.col("x").alias("x1"), F.col("x").alias("x2"))

    all_ = again.select(*keys, F.lit(-1).alias("x1"), F.lit(-1).alias("x2")).unionByName(node_again).unionByName(one)
    return all_.groupBy("k1", "k2").agg(F.collect_set(F.struct("number", "x1", "x2")).alias("found"))


def _named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("bigint"), F.lit(-(1 << 63))).alias("k1"), F.xxhash64(t).alias("k2"), t.alias("text"))


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, node: int = NODE) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, spans, kept_sha256)``; ``spans`` are the removed byte ranges ``[start, end)``."""
    ship(docs.sparkSession)
    found = stored(repeated_ranges(docs, doc_id=doc_id, text=text, length=length, gram=gram, node=node), "repeats-found")
    rows = _named(docs, doc_id, text).join(found.hint("shuffle_hash"), ["k1", "k2"], "left")
    kind = docs.schema[doc_id].dataType.simpleString()
    return rows.select("doc_id", "text", "found").mapInArrow(_cut(length, gram), f"doc_id {kind}, n_bytes bigint, n_removed bigint, spans array<array<bigint>>, kept_sha256 string")
