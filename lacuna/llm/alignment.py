"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids go together in the corpus.

Texts are tokenised with a space in front, by byte-level BPE (A) and piece BPE (B, which adds the space itself).  For each
batch, ``merge_asof`` keyed by the text stretch finds, for each token start, the other side's token that covers it; both
directions together are all overlaps of an A and a B token.  Places where both sides' tokens end cut the tokens into
groups.  All A tokens of a group are linked with all its B tokens.

The stretches are a document's units (``units``): both sides end a token at every cut between two units, so a document's
overlaps, groups and links are those of its units, one after another, and each distinct unit is aligned once.

An id pair counts the documents that hold it linked.  Workers count pairs over the distinct units of each document and
send one row a pair; the counts of all pairs are a table in the shared folder.  Its most frequent pairs (at most ``head``)
go to all tasks as sorted arrays; a document's other pairs are joined with the table.  Rare pairs are many but each has
few rows, so no key of that join is hot.

Defined results: texts that are null or empty, or whose joined A or B bytes differ from space + text (a text holding the
space mark U+2581, say), have no tokens: zeros and an empty digest.  Repeated rows count as documents each; a null id is an
id like any other; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import ship, stored
from .text import slices
from .units import Runs, UnitTable, byte_level_alphabet, byte_level_cuts, piece_cuts, sums_per_row, unit_ids, unit_starts

HEAD = 1 << 21  # most frequent id pairs sent to all tasks: 17 bytes each
MOST_UNITS = 400_000  # distinct units a Python worker remembers, with the text of their groups
SLICE = 1 << 20  # text bytes handled at once
PAIR = np.int64(1) << 32  # an id pair is a * PAIR + b


def without_prefix(piece_file: str):
    """The piece model, set to put no space in front of a text."""
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(piece_file, "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.add_dummy_prefix = False
    return SentencePieceProcessor(model_proto=model.SerializeToString())


def covering(tokens: pd.DataFrame, others: pd.DataFrame) -> pd.Series:
    """For each of ``tokens`` (sorted by start) the number of the token of ``others`` that covers its first byte."""
    return pd.merge_asof(tokens, others, on="start", by="unit", suffixes=("", "_other"))["number_other"]


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """All pairs ``(a, b)`` of token numbers whose byte ranges overlap; inputs: ``unit, start, number``, sorted by start.

    Of two overlapping tokens one starts inside the other, so the two directions together miss none.
    """
    left = pd.DataFrame({"a": a["number"].to_numpy(), "b": covering(a, b).to_numpy()})
    right = pd.DataFrame({"a": covering(b, a).to_numpy(), "b": b["number"].to_numpy()})
    return pd.concat([left, right], ignore_index=True).drop_duplicates()


class Aligner:
    """Tokens, groups and links of distinct units, by number of the unit in ``table``."""

    def __init__(self, byte_file: str, piece_file: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        self.cut = byte_level_cuts(byte_file) and piece_cuts(piece_file)
        self.b_bare = without_prefix(piece_file)  # units bring their own space or have none
        alphabet = byte_level_alphabet()
        self.alphabet = [c for _, c in sorted((b, c) for c, b in alphabet.items())]
        size = 1 + max(self.a.get_vocab().values(), default=0)
        self.a_bytes: list[bytes] = [b""] * size
        for token, k in self.a.get_vocab().items():
            self.a_bytes[k] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode()
                        for k, p in ((k, self.b.id_to_piece(k)) for k in range(self.b.get_piece_size()))]
        self.a_size = np.fromiter(map(len, self.a_bytes), np.int64, len(self.a_bytes))
        self.b_size = np.fromiter(map(len, self.b_bytes), np.int64, len(self.b_bytes))
        self.names = np.array(list(map(str, range(max(len(self.a_bytes), len(self.b_bytes))))), object)
        self.table = UnitTable(self._learn, self.clear, MOST_UNITS)
        self.links = Runs(np.int64)  # pairs of each unit, by number
        self.times = Runs(np.int64)  # and how often each is linked in it
        self.with_text = True  # counting needs no text of the groups and no overlaps
        self.clear()

    def clear(self) -> None:
        """Forgets all units and pairs."""
        self.pairs = np.zeros(0, np.int64)  # distinct id pairs, by number
        self._pair_keys, self._pair_numbers = np.zeros(0, np.int64), np.zeros(0, np.int64)  # the same, sorted
        self.links.clear()
        self.times.clear()
        self.text: list[str] = []
        self._counts = [np.zeros((0, 6), np.int64)]

    @property
    def counts(self) -> np.ndarray:
        """For each unit: tokens of A, of B, groups, links, overlaps, and 1 if its bytes do not come back."""
        if len(self._counts) > 1:
            self._counts = [np.concatenate(self._counts)]
        return self._counts[0]

    def _learn(self, new: list[bytes]) -> None:
        strings = [u.decode() for u in new]
        a_ids = unit_ids(self.a, new, self.cut, self.alphabet)
        if self.cut:
            b_ids = self.b_bare.encode(strings, out_type=int, num_threads=1)
        else:  # a whole text with a space in front, which the model puts there itself
            b_ids = self.b.encode([s[1:] for s in strings], out_type=int, num_threads=1)
        bad, sides = np.zeros(len(new), bool), []
        length = np.fromiter(map(len, new), np.int64, len(new))
        for ids, table, size in ((a_ids, self.a_bytes, self.a_size), (b_ids, self.b_bytes, self.b_size)):
            many = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.int64, int(many.sum()))
            same = sums_per_row(size[flat], np.r_[0, np.cumsum(many)]) == length
            if not same.all() or b"".join(map(table.__getitem__, flat.tolist())) != b"".join(new):  # some unit differs: look at each
                bad |= np.fromiter((b"".join(table[i] for i in x) != u for x, u in zip(ids, new)), bool, len(new))
            sides.append((many, flat, size))
        # tokens of each side in order: unit, id, start and end within the unit, and group
        a, b = (self._tokens(bad, *side) for side in sides)
        # a token's group: shared ends up to its start, numbered on within the batch
        ends = [s["unit"] << 40 | s["end"] for s in (a, b)]  # sorted: both sides are
        at = np.minimum(np.searchsorted(ends[1], ends[0]), max(len(ends[1]) - 1, 0))
        key = ends[0][ends[1][at] == ends[0]] if len(ends[1]) else ends[1]
        for side in (a, b):
            side["group"] = np.searchsorted(key, side["unit"] << 40 | side["start"], side="right")
        n_a, n_b = (np.bincount(s["group"], minlength=len(key)) for s in (a, b))
        self._add_pairs(a, b, key >> 40, n_a, n_b, len(new))
        laps = np.zeros(len(new), np.int64)
        if self.with_text:
            self._add_text(a, b, key >> 40, len(new))
            laps = np.bincount(a["unit"][self._overlaps(a, b)["a"]], minlength=len(new))
        self._counts.append(np.stack([
            np.bincount(a["unit"], minlength=len(new)), np.bincount(b["unit"], minlength=len(new)), np.bincount(key >> 40, minlength=len(new)),
            sums_per_row(n_a * n_b, np.searchsorted(key >> 40, np.arange(len(new) + 1))), laps, bad,
        ], axis=1).astype(np.int64))

    @staticmethod
    def _tokens(bad: np.ndarray, many: np.ndarray, flat: np.ndarray, size: np.ndarray) -> dict[str, np.ndarray]:
        """Unit, id, start and end of every token of the units that are not ``bad``."""
        if bad.any():
            flat, many = flat[np.repeat(~bad, many)], np.where(bad, 0, many)
        unit, to = np.repeat(np.arange(len(many)), many), np.cumsum(size[flat])
        base = np.r_[0, to][np.cumsum(many) - many][unit]
        return {"unit": unit, "id": flat, "start": to - size[flat] - base, "end": to - base}

    @staticmethod
    def _overlaps(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> pd.DataFrame:
        sides = [pd.DataFrame({"unit": s["unit"], "start": s["start"], "number": np.arange(len(s["unit"]))}).sort_values("start", kind="stable") for s in (a, b)]
        return overlaps(*sides)

    def _add_pairs(self, a: dict[str, np.ndarray], b: dict[str, np.ndarray], unit: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, many: int) -> None:
        """Distinct id pairs linked in each unit with the number of links: all A ids by all B ids of a group, summed."""
        width = np.int64(len(self.b_bytes))
        # each A token beside all B tokens of its group
        times = n_b[a["group"]]
        first = (np.cumsum(n_b) - n_b)[a["group"]]
        other = np.arange(int(times.sum())) + np.repeat(first - (np.cumsum(times) - times), times)
        pair = np.repeat(a["id"], times) * width + b["id"][other]
        of = np.repeat(unit[a["group"]], times)
        order = np.lexsort((pair, of))
        pair, of = pair[order], of[order]
        at = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (of[1:] != of[:-1])][: len(pair)])
        pair, of, links = pair[at], of[at], np.diff(np.r_[at, len(pair)])
        distinct, back = np.unique(pair // width * PAIR + pair % width, return_inverse=True)
        place = np.searchsorted(self._pair_keys, distinct)
        new = np.ones(len(distinct), bool)
        inside = place < len(self._pair_keys)
        new[inside] = self._pair_keys[place[inside]] != distinct[inside]
        number = len(self.pairs) + np.arange(int(new.sum()))
        self.pairs = np.r_[self.pairs, distinct[new]]
        self._pair_keys = np.insert(self._pair_keys, place[new], distinct[new])
        self._pair_numbers = np.insert(self._pair_numbers, place[new], number)
        count = np.bincount(of, minlength=many)
        self.links.add(self._pair_numbers[np.searchsorted(self._pair_keys, distinct)][back], count)
        self.times.add(links, count)

    def _add_text(self, a: dict[str, np.ndarray], b: dict[str, np.ndarray], unit: np.ndarray, many: int) -> None:
        """``a1,a2|b1;a3|b2`` of every unit."""
        n_a, n_b = (np.bincount(s["group"], minlength=len(unit)) for s in (a, b))
        before_b, upto_a = np.cumsum(n_b) - n_b, np.cumsum(n_a)
        places = np.arange(len(a["id"])) + before_b[a["group"]], np.arange(len(b["id"])) + upto_a[b["group"]]
        ids, after = (np.zeros(len(places[0]) + len(places[1]), np.int64) for _ in range(2))  # a token's id and the mark after it
        for side, place in zip((a, b), places):
            ids[place] = side["id"]
        after[(upto_a + before_b - 1)] = 1
        after[(upto_a + np.cumsum(n_b) - 1)] = np.where(np.r_[unit[1:] != unit[:-1], True][: len(unit)], 3, 2)
        parts = np.empty(2 * len(ids), object)
        parts[0::2], parts[1::2] = self.names[ids], np.array([",", "|", ";", "\n"], object)[after]
        lines = [""] * many
        for k, line in zip(np.unique(unit).tolist(), "".join(parts.tolist()).split("\n")):
            lines[k] = line
        self.text += lines

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit numbers of all rows, each with a space in front, and where each row's units begin."""
        many = np.diff(offsets)
        data = np.insert(data, offsets[:-1][many > 0], 32)
        offsets = offsets + np.r_[0, np.cumsum(many > 0)]
        if self.table.full():
            self.table.clear()
        starts = unit_starts(data, offsets, self.cut)
        return self.table.look_up(data, starts), np.searchsorted(starts, offsets)


_aligners: dict[tuple[str, str], Aligner] = {}


def _aligner(files: tuple[str, str], with_text: bool) -> Aligner:
    if files not in _aligners:
        _aligners[files] = Aligner(*files)
    model = _aligners[files]
    if model.with_text != with_text:
        model.table.clear()
        model.with_text = with_text
    return model


def _without_bad(model: Aligner, units: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The units of rows whose bytes come back on both sides; other rows are left with none."""
    bad = sums_per_row(model.counts[units, 5], cut) > 0
    if not bad.any():
        return units, cut
    many = np.where(bad, 0, np.diff(cut))
    return units[np.repeat(~bad, np.diff(cut))], np.r_[0, np.cumsum(many)]


def _row_pairs(model: Aligner, units: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, pair number, links)`` of every distinct pair of a row."""
    row = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    size = len(model.table.keys) + 1
    held, again = np.unique(row * size + units, return_counts=True)
    row, units = held // size, held % size
    pair, many = model.links.take(units)
    times = model.times.take(units)[0] * np.repeat(again, many)
    size = len(model.pairs) + 1
    key, back = np.unique(np.repeat(row, many) * size + pair, return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, back, times)
    return key // size, key % size, total


def _count(files: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _aligner(files, False)
        held = np.zeros(0, np.int64)

        def rows() -> pa.RecordBatch:
            some = np.flatnonzero(held)
            pairs = model.pairs[some]
            return pa.record_batch([pa.array(pairs), pa.array(held[some])], names=["pair", "n"])

        for batch in batches:
            for _, data, offsets in slices(batch, "_text", SLICE):
                if model.table.full():  # numbers of pairs are about to change
                    yield rows()
                    held = np.zeros(0, np.int64)
                units, cut = _without_bad(model, *model.units(data, offsets))
                _, pair, _ = _row_pairs(model, units, cut)
                held = np.pad(held, (0, len(model.pairs) - len(held)))
                held += np.bincount(pair, minlength=len(held))
        yield rows()

    return run


def pair_counts(docs: DataFrame, byte_file: str, piece_file: str, *, text: str = "text") -> DataFrame:
    """``(a, b, n, best)``: documents that hold an A and a B id linked, and whether no B id has more with this A id."""
    spark = docs.sparkSession
    ship(spark)
    found = docs.select(F.col(text).alias("_text")).mapInArrow(_count((byte_file, piece_file)), "pair bigint, n bigint")
    found = stored(found.groupBy("pair").agg(F.sum("n").alias("n")), "alignment-counts")
    found = found.select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(int(PAIR) - 1).alias("b"), "n")
    top = found.groupBy("a").agg(F.max("n").alias("most"))  # at most one row an id of A
    return found.join(top, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def _floor(counts: DataFrame, head: int) -> int:
    """The smallest count such that at most ``head`` pairs have it or more, out of 16 steps for each power of two."""
    step = F.floor(F.log2("n") * 16)
    rows = {int(r[0]): int(r[1]) for r in counts.groupBy(step.alias("s")).count().collect()}  # at most 1,024 rows
    total, low = 0, max(rows, default=0) + 1
    for s in sorted(rows, reverse=True):
        if total + rows[s] > head:
            break
        total, low = total + rows[s], s
    return low


def _score(files: tuple[str, str], sent, keep_groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _aligner(files, True)
        keys, counts, best = sent.value
        n_of, best_of = np.zeros(0, np.int64), np.zeros(0, np.int64)
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows, data, offsets in slices(batch, "_text", SLICE):
                if model.table.full():
                    n_of, best_of = np.zeros(0, np.int64), np.zeros(0, np.int64)
                units, cut = _without_bad(model, *model.units(data, offsets))
                pairs = model.pairs[len(n_of) :]
                at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
                known = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
                n_of = np.r_[n_of, np.where(known, counts[at], -1) if len(keys) else np.full(len(pairs), -1)]
                best_of = np.r_[best_of, np.where(known, best[at], 0) if len(keys) else np.zeros(len(pairs), np.int64)]
                row, pair, times = _row_pairs(model, units, cut)
                of_row = np.searchsorted(row, np.arange(rows.num_rows + 1))
                sums = [sums_per_row(v, of_row) for v in (times * best_of[pair], times * np.maximum(n_of[pair], 0))]
                rare = n_of[pair] < 0
                rare_cut = np.r_[0, np.cumsum(rare)][of_row]
                names = model.pairs[pair[rare]]
                whole = [sums_per_row(model.counts[units, k], cut) for k in range(5)]
                groups = [";".join(map(model.text.__getitem__, units[p:q].tolist())) for p, q in zip(cut[:-1], cut[1:])]
                digest = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                lists = [pa.ListArray.from_arrays(pa.array(rare_cut, pa.int32()), pa.array(v)) for v in (names, times[rare])]
                key = (np.int64(part) << np.int64(40)) + number + np.arange(rows.num_rows)
                number += rows.num_rows
                yield pa.record_batch(
                    [rows.column(rows.schema.get_field_index("doc_id")), *(pa.array(w) for w in whole), *(pa.array(s) for s in sums),
                     pa.array(digest, pa.string()), pa.array(groups if keep_groups else [None] * len(groups), pa.string()), pa.array(key), *lists],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_overlaps", "n_best", "count_sum", "groups_sha256", "groups", "_row", "_rare", "_times"],
                )

    return run


def align(docs: DataFrame, byte_file: str, piece_file: str, *, doc_id: str = "doc_id", text: str = "text",
          keep_groups: bool = False, head: int = HEAD) -> DataFrame:
    """One row a document: ``doc_id, n_a, n_b, n_groups, n_links, n_overlaps, n_best, count_sum, groups_sha256, groups``.

    ``n_best``: links whose pair no other pair of their A id exceeds; ``count_sum``: documents holding the pair, over all
    links.  ``groups`` is the text ``a1,a2|b1;a3|b2,b3`` behind the digest with ``keep_groups``, else null.
    """
    spark: SparkSession = docs.sparkSession
    files = (byte_file, piece_file)
    counts = stored(pair_counts(docs, byte_file, piece_file, text=text), "alignment-pairs")
    step = F.floor(F.log2("n") * 16)
    low = _floor(counts, head)
    sent = counts.where(step >= low).select((F.col("a") * int(PAIR) + F.col("b")).alias("pair"), "n", F.col("best").cast("bigint").alias("best")).toArrow()
    arrays = [sent.column(k).to_numpy().astype(np.int64, copy=False) for k in range(3)]
    order = np.argsort(arrays[0], kind="stable")
    keys = spark.sparkContext.broadcast([v[order].astype(np.int8) if k == 2 else v[order] for k, v in enumerate(arrays)])
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_overlaps", "n_best", "count_sum"]
    schema = T.StructType([rows.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in numbers),
                           *(T.StructField(c, T.StringType()) for c in ("groups_sha256", "groups")), T.StructField("_row", T.LongType()),
                           *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("_rare", "_times"))])
    scored = rows.mapInArrow(_score(files, keys, keep_groups), schema)
    kept = ["doc_id", *numbers, "groups_sha256", "groups"]
    if sent.num_rows == counts.count():  # all pairs were sent
        return scored.select(*kept)
    scored = stored(scored, "alignment-rows")
    rest = scored.select("_row", F.inline(F.arrays_zip(F.col("_rare").alias("pair"), F.col("_times").alias("times"))).alias("pair", "times"))
    rare = counts.where(step < low).select((F.col("a") * int(PAIR) + F.col("b")).alias("pair"), "n", "best")
    added = rest.join(rare, "pair").groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum"))
    whole = scored.drop("_rare", "_times").join(added, "_row", "left")
    for c, more in (("n_best", "_best"), ("count_sum", "_sum")):
        whole = whole.withColumn(c, F.col(c) + F.coalesce(F.col(more), F.lit(0)))
    return whole.select(*kept)
