"""Token ids as directly addressable codes: any id is read from the file without decoding what stands before it.

An id is split into chunks of eight bits.  Level 0 holds the lowest chunk of every id, level ``k`` the next chunk of those
ids that go on.  A bitmap for each level says which do, and its rank directory (ones before each 512-bit block and, within
it, before each 64-bit word) gives an id's place on the next level: one rank for each level, no decoding of blocks.

A file image holds the ids of neighbouring documents, their directory (end of each document, its id as text) and the
levels.  Images are rows of a Parquet table under the shared folder (``part``, ``number``, ``start``: ids before it within
its part, ``n_ids``, ``data``), so that any store Spark writes to can hold them.  Parts are ranges of documents in
ascending id, so an image's place in the whole corpus is its own start plus the ids of the parts before.

Defined results: null text is the empty document (its closing id alone); a null id comes first; rows with one id stand
next to each other in order of their text's hash, each with its own place; an empty table gives no image and no row; extra
columns are not read.  Texts are never cut: a long text is one document of one image.  A special token's string in a text
is that token, as the library has it by default.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import ship, stored
from .text import slices
from .units import Runs, UnitTable, byte_level_alphabet, byte_level_cuts, task_tokenizer, unit_ids, unit_starts

END_ID = 2
IMAGE_IDS = 1 << 18  # ids after which an image is closed (it then ends with its last document)
SLICE = 1 << 18  # text bytes handled at once
MOST_IDS = 1 << 22  # ids of remembered units; a text that holds a special token's string is one unit
MAGIC = b"LACUDAC1"


def _section(values: np.ndarray, dtype: str) -> bytes:
    raw = np.ascontiguousarray(values, dtype).tobytes()
    return raw + b"\0" * (-len(raw) % 8)


def _directory(more: np.ndarray) -> list[bytes]:
    """A bitmap (64-bit words), ones before each 512-bit block, and ones before each word within its block."""
    bits = np.packbits(more, bitorder="little")
    word = np.frombuffer(bits.tobytes() + b"\0" * (-len(bits) % 8), "<u8")
    ones = np.bitwise_count(word).astype(np.int64)
    before = np.cumsum(ones) - ones
    block = before[::8]
    return [_section(word, "<u8"), _section(block, "<u8"), _section(before - np.repeat(block, 8)[: len(before)], "<u2")]


def image(ids: np.ndarray, ends: np.ndarray, names: list[str | None]) -> bytes:
    """The file image of ``ids``, cut into documents at ``ends`` (ids up to and with each), with the documents' names."""
    ids = np.asarray(ids, np.uint32)
    levels, rest = [], ids
    while True:
        more = rest > 255
        levels.append((rest.astype(np.uint8), more))
        rest = rest[more] >> 8
        if not len(rest):
            break
    text = [(n or "").encode() for n in names]
    body = [
        _section(ends, "<u8"),
        _section(np.fromiter((n is None for n in names), bool, len(names)), "u1"),
        _section(np.cumsum([len(t) for t in text], dtype=np.int64) if text else np.zeros(0), "<u8"),
        _section(np.frombuffer(b"".join(text), np.uint8), "u1"),
    ]
    for chunks, more in levels:
        body += [_section(chunks, "u1"), *_directory(more)]
    head = np.array([len(ids), len(ends), sum(map(len, text)), len(levels), *(len(c) for c, _ in levels)], "<u8")
    return MAGIC + head.tobytes() + b"".join(body)


class Image:
    """A reader of one file image; nothing is decoded before it is asked for."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not an image of directly addressable codes")
        self.n, docs, n_text, n_levels = (int(x) for x in np.frombuffer(data, "<u8", 4, 8))
        at = 40 + 8 * n_levels
        sizes = np.frombuffer(data, "<u8", n_levels, 40).astype(np.int64).tolist()

        def take(dtype: str, many: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, dtype, many, at)
            at += got.nbytes + -got.nbytes % 8
            return got

        self.ends = take("<u8", docs).astype(np.int64)
        self._null = take("u1", docs)
        self._name_ends = take("<u8", docs).astype(np.int64)
        self._text = take("u1", n_text)
        self.levels = []
        for many in sizes:
            words = -(-many // 64)
            self.levels.append((take("u1", many), take("<u8", words), take("<u8", -(-words // 8)), take("<u2", words)))

    def names(self) -> list[str | None]:
        cut = np.r_[0, self._name_ends]
        raw = self._text.tobytes()
        return [None if null else raw[a:b].decode() for null, a, b in zip(self._null, cut[:-1], cut[1:])]

    def _rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ids before place ``at`` of a level that go on to the next."""
        _, word, block, inner = self.levels[level]
        k = at >> 6
        below = word[k] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return block[k >> 3].astype(np.int64) + inner[k] + np.bitwise_count(below)

    def ids(self, places: np.ndarray) -> np.ndarray:
        """The ids at any places, in the order asked."""
        at = np.asarray(places, np.int64)
        if len(at) and (at.min() < 0 or at.max() >= self.n):
            raise IndexError("place outside the image")
        out, which = np.zeros(len(at), np.uint32), np.arange(len(at))
        for level, (chunks, word, _, _) in enumerate(self.levels):
            out[which] |= chunks[at].astype(np.uint32) << np.uint32(8 * level)
            on = (word[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            which, at = which[on], self._rank(level, at[on])
        return out

    def span(self, first: int, past: int) -> np.ndarray:
        """The ids at places ``first .. past - 1``: on each level they stand in one run, found by two ranks."""
        out, which = np.zeros(past - first, np.uint32), slice(None)
        for level, (chunks, word, _, _) in enumerate(self.levels):
            if past == first:
                break
            part = chunks[first:past].astype(np.uint32) << np.uint32(8 * level)
            out[which] |= part
            bits = np.unpackbits(word[first >> 6 : (past - 1 >> 6) + 1].view(np.uint8), bitorder="little")
            on = np.flatnonzero(bits[first & 63 : (first & 63) + past - first])
            which = on if isinstance(which, slice) else which[on]
            first = int(self._rank(level, np.array([first]))[0])
            past = first + len(on)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.span(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


class Encoder:
    """Ids of whole texts by a tokenizer file; each distinct unit is encoded once (see ``units``)."""

    def __init__(self, path: str):
        self.tokenizer = task_tokenizer(path)
        self.cut = byte_level_cuts(path)
        self.alphabet = [c for _, c in sorted((b, c) for c, b in byte_level_alphabet().items())]
        self.marks = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.runs = Runs(np.uint32)
        self.table = UnitTable(self._learn, self.runs.clear)

    def _learn(self, new: list[bytes]) -> None:
        found = unit_ids(self.tokenizer, new, self.cut, self.alphabet)
        count = np.fromiter(map(len, found), np.int64, len(found))
        self.runs.add(np.fromiter(chain.from_iterable(found), np.uint32, int(count.sum())), count)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, one row after another, and where each row's ids begin (one more entry than rows)."""
        raw = data.tobytes()
        cut = self.cut and not any(m in raw for m in self.marks)  # a special token may hold or take in a space
        if self.table.full() or len(self.runs.values) > MOST_IDS:
            kept = self.runs.take(self.table.trim())
            self.runs.clear()
            self.runs.add(*kept)
        starts = unit_starts(data, offsets, cut)
        numbers = self.table.look_up(data, starts)
        ids, many = self.runs.take(numbers)
        return ids, np.r_[0, np.cumsum(many)][np.searchsorted(starts, offsets)]


_encoders: dict[str, Encoder] = {}


def _images(path: str, end_id: int, image_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _encoders[path] = _encoders.get(path) or Encoder(path)
        part = TaskContext.get().partitionId()
        held, ends, names = [], [], []
        count, start, number = 0, 0, 0

        def close() -> pa.RecordBatch:
            row = [part, number, start, count, image(np.concatenate(held), np.array(ends), names)]
            return pa.record_batch([pa.array([v]) for v in row], names=["part", "number", "start", "n_ids", "data"])

        for batch in batches:
            for rows, data, offsets in slices(batch, "_text", SLICE):
                ids, cut = model.encode(data, offsets)
                known = rows.column(rows.schema.get_field_index("_name")).to_pylist()
                for k, name in enumerate(known):
                    held += [ids[cut[k] : cut[k + 1]], np.array([end_id], np.uint32)]
                    count += int(cut[k + 1] - cut[k]) + 1
                    ends.append(count)
                    names.append(name)
                    if count >= image_ids:
                        yield close()
                        start, number = start + count, number + 1
                        held, ends, names, count = [], [], [], 0
        if ends:
            yield close()

    return run


def write_ids(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text",
              end_id: int = END_ID, image_ids: int = IMAGE_IDS) -> DataFrame:
    """Writes all documents' ids in ascending id order; the table of images, read back from the shared folder."""
    ship(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("_id"), body.alias("_text"), F.xxhash64(body).alias("_hash"),
                       F.monotonically_increasing_id().alias("_row"))
    keys = [F.col("_id").asc_nulls_first(), "_hash", "_row"]  # the last only spreads equal rows, which may stand either way round
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = rows.select(F.col("_id").cast("string").alias("_name"), "_text")
    schema = "part bigint, number bigint, start bigint, n_ids bigint, data binary"
    return stored(rows.mapInArrow(_images(tokenizer, end_id, image_ids), schema), "token-ids")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = Image(data.as_py())
            first = np.r_[0, found.ends[:-1]]
            codes = [zlib.crc32(found.document(k).astype("<u4").tobytes()) for k in range(len(first))]
            columns = [found.names(), first + start, found.ends - first, codes]
            yield pa.record_batch([pa.array(columns[0], pa.string()), *(pa.array(np.array(c, np.int64)) for c in columns[1:])],
                                  names=["_name", "start", "n_tokens", "ids_crc32"])


def read_documents(images: DataFrame, id_type: T.DataType | str = "bigint") -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the images alone."""
    ship(images.sparkSession)
    parts = images.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row a range of documents
    base = parts.select(F.col("part").alias("_part"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("_base"))
    rows = images.join(F.broadcast(base), F.col("part") == F.col("_part")).select((F.col("start") + F.col("_base")).alias("start"), "data")
    found = rows.mapInArrow(_read, "_name string, start bigint, n_tokens bigint, ids_crc32 bigint")
    return found.select(F.col("_name").cast(id_type).alias("doc_id"), "start", "n_tokens", "ids_crc32")
