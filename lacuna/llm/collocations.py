"""Phrase collocations per language: exact counts by burst tries, scores of the weakest cut, phrases within longer ones.

Counting goes by phrase length, one to four words, in a pass over the texts each.  A phrase is counted only where both
phrases of one word less in it reach the least count, since a rarer one could not reach it.  Each task counts in a
HAT-trie: a shallow trie over word ids whose leaves are hash containers of the remaining ids, burst into a trie node once
they grow.  Beyond ``held`` entries the largest subtrees leave it whole as sorted runs of (phrase, count).  The runs meet
per prefix partition (language and first two words), where Spark adds them up.

Which phrases of one word less are frequent is told by a bit map of at most ``2**MOST_BITS`` bits, whatever the corpus.
A bit set by another phrase only lets a rare phrase be counted; it is dropped by its count.  So all counts are exact.

A candidate's parts occur at least as often as the candidate, so both are in the tables of frequent phrases.  Scores are
``floor(2000000 * a / (l + r))`` in decimals of 38 digits.

Defined results: null and empty texts have no words; a null language counts as ``und``; repeated rows count each; without
candidates or rows the result is empty; extra columns are not read.  Long texts are handled in slices of bounded rows, a
single text whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import ship, stored
from .text import LOWER, mix, prefix_sums, slices, span_hash
from .units import Runs

LEAST = 30
MOST_WORDS = 4
TOP = 2000
ID_BITS = 21
MOST_IDS = 1 << 20  # distinct words a worker numbers before it spills all and starts anew
SLICE = 1 << 20  # text bytes handled at once; they hold at most 2**19 words
BURST = 4096  # entries of a container that is burst
HELD = 800_000  # entries of a worker's trie
MOST_BITS = 28
UNKNOWN = "und"
SALTS = 64

_ENDS = np.zeros(256, dtype=bool)  # bytes that end a piece
_ENDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_BETWEEN = _ENDS.copy()  # bytes outside words
_BETWEEN[[9, 32]] = True


class HatTrie:
    """Counts of rows of ``width`` ids (each below ``2**ID_BITS``).

    The root is a trie node over blocks of first ids.  A child is a hash container from the ids, packed into one number
    (of the first id, its place in the block), to their count, or, once burst, a node over the next id.  Rows of one id
    need no trie below the root: their counts are one array.
    """

    def __init__(self, width: int, burst: int = BURST, held: int = HELD):
        self.width, self.burst, self.held = width, burst, held
        self.block_bits = 6 if width * ID_BITS < 64 - ID_BITS + 6 else 0
        self.root: dict[int, dict | Node] = {}
        self.sizes: dict[int, int] = {}
        self.flat = np.zeros(0, np.int64)  # counts of single ids
        self.total = 0

    def add(self, rows: np.ndarray, counts: np.ndarray) -> None:
        """Adds distinct rows, sorted, with their counts."""
        if not len(rows):
            return
        first = rows[:, 0]
        if self.width == 1:
            size = int(first[-1]) + 1
            self.flat = np.pad(self.flat, (0, max(size - len(self.flat), 0)))
            self.total += int((self.flat[first] == 0).sum())
            self.flat[first] += counts
            return
        block = first >> self.block_bits
        rest = first & ((1 << self.block_bits) - 1)
        for k in range(1, self.width):
            rest = (rest << ID_BITS) | rows[:, k]
        cut = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        keys, many, blocks = rest.tolist(), counts.tolist(), block[cut[:-1]].tolist()
        for f, a, b in zip(blocks, cut[:-1], cut[1:]):
            self.root[f], grown = self._put(self.root.get(f, {}), keys[a:b], many[a:b], self.width)
            self.sizes[f] = self.sizes.get(f, 0) + grown
            self.total += grown

    def _put(self, at, keys: list[int], counts: list[int], left: int):
        """Adds to a child that spans ``left`` ids; the child (a node where it was burst) and its new entries."""
        if isinstance(at, Node):
            shift, grown, a = ID_BITS * (left - 1), 0, 0
            low = (1 << shift) - 1
            while a < len(keys):
                here = keys[a] >> shift
                b = a + 1
                while b < len(keys) and keys[b] >> shift == here:
                    b += 1
                at.children[here], more = self._put(at.children.get(here, {}), [k & low for k in keys[a:b]], counts[a:b], left - 1)
                grown, a = grown + more, b
            return at, grown
        before = len(at)
        for k, n in zip(keys, counts):
            at[k] = at.get(k, 0) + n
        grown = len(at) - before
        if len(at) > self.burst and left > 1:
            node, keys = Node(), sorted(at)
            self._put(node, keys, [at[k] for k in keys], left)
            return node, grown
        return at, grown

    def spill(self, keep: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Takes out whole subtrees, the largest first, until at most ``keep`` entries stay; their rows and counts."""
        if self.width == 1 and self.total > keep:
            some = np.flatnonzero(self.flat)
            yield some[:, None], self.flat[some]
            self.flat, self.total = np.zeros(0, np.int64), 0
        for f in sorted(self.sizes, key=self.sizes.get, reverse=True):
            if self.total <= keep:
                break
            found = list(self._walk(self.root.pop(f), 0, self.width))
            self.total -= self.sizes.pop(f)
            rest = np.concatenate([k for k, _ in found])
            rows = np.empty((len(rest), self.width), np.int64)
            for k in range(self.width - 1, 0, -1):
                rows[:, k] = rest & ((1 << ID_BITS) - 1)
                rest = rest >> ID_BITS
            rows[:, 0] = f << self.block_bits | rest
            yield rows, np.concatenate([c for _, c in found])

    def _walk(self, at, above: int, left: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if isinstance(at, Node):
            for here, child in at.children.items():
                yield from self._walk(child, above | here << ID_BITS * (left - 1), left - 1)
        else:
            yield np.fromiter(at.keys(), np.int64, len(at)) | above, np.fromiter(at.values(), np.int64, len(at))


class Node:
    """A trie node: children by word id."""

    __slots__ = ("children",)

    def __init__(self):
        self.children: dict = {}


class Words:
    """Numbers of distinct words by hash (which takes in the language), with their language and bytes."""

    def __init__(self):
        self.keys, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.langs: list[str] = []
        self.lang_of, self.bytes = Runs(np.int64), Runs(np.uint8)

    def look_up(self, lang: str, hashes: np.ndarray, data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Numbers (from 0) of words that stand at ``first .. last - 1`` of ``data``."""
        keys, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        if new.any():
            if not self.langs or self.langs[-1] != lang:
                self.langs.append(lang)
            many = int(new.sum())
            size = (last - first)[where[new]]
            to = np.cumsum(size)
            self.bytes.add(data[np.repeat(first[where[new]] - (to - size), size) + np.arange(int(to[-1]))], size)
            self.lang_of.add(np.full(many, len(self.langs) - 1), np.ones(many, np.int64))
            number = len(self.numbers) + np.arange(many)
            self.keys, self.numbers = np.insert(self.keys, at[new], keys[new]), np.insert(self.numbers, at[new], number)
            at = np.searchsorted(self.keys, keys)
        return self.numbers[at][back]

    def arrays(self, numbers: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Languages and words of the given numbers."""
        body, size = self.bytes.take(numbers)
        ends = np.r_[0, np.cumsum(size)]
        text = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(ends), pa.py_buffer(body)).cast(pa.string())
        return pa.array(self.langs, pa.string()).take(pa.array(self.lang_of.values[numbers])), text


def _fold(hashes: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Hash of phrases that go on by one word."""
    return mix(hashes * np.uint64(0x9E3779B97F4A7C15) + more)


def _salt(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode()))


def piece_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last byte (exclusive) of all words, their hashes without language, and which go on from the word before."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_BETWEEN[data]
    opens = inside[1:-1] & ~inside[:-2]
    closes = inside[1:-1] & ~inside[2:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    opens[edges] = inside[1:-1][edges]
    closes[edges - 1] = inside[1:-1][edges - 1]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    ends = np.zeros(len(data) + 1, np.int32)
    ends[:-1] = _ENDS[data]
    np.add.at(ends, edges, 1)  # a row ends before its first byte
    ends = np.cumsum(ends)
    on = np.zeros(len(first), bool)
    on[1:] = ends[first[1:]] == ends[last[:-1] - 1]
    return first, last, span_hash(prefix_sums(data), first, last), on


def distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct rows of ids and how often each occurs."""
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    key = rows[:, 0]
    for k in range(1, rows.shape[1]):
        if k == 3:  # three ids fill 63 bits; go on with their rank
            key = np.unique(key, return_inverse=True)[1]
        key = (key << ID_BITS) | rows[:, k]
    _, first, counts = np.unique(key, return_index=True, return_counts=True)
    return rows[first], counts


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    langs = batch.column(batch.schema.get_field_index("_lang"))
    for lang in pc.unique(langs).to_pylist():
        yield lang, batch.filter(pc.equal(langs, lang))


def _runs(width: int, sent, held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value if sent is not None else None
        words, trie = Words(), HatTrie(width, held=held)

        def rows(keep: int = 0) -> Iterator[pa.RecordBatch]:
            """Sorted runs of the subtrees that leave the trie."""
            out = list(trie.spill(keep))
            if not out:
                return
            ids, counts = np.concatenate([r for r, _ in out]), np.concatenate([c for _, c in out])
            some, back = np.unique(ids, return_inverse=True)
            langs, text = words.arrays(some)
            order = pc.sort_indices(pa.table([langs, text], names=["lang", "word"]), [("lang", "ascending"), ("word", "ascending")]).to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            back = back.reshape(ids.shape)
            by = np.lexsort([rank[back[:, k]] for k in range(width - 1, -1, -1)])
            back, counts = back[by], counts[by]
            for at in range(0, len(back), 20_000):
                part = back[at : at + 20_000]
                columns = [text.take(pa.array(part[:, k])) for k in range(width)]
                head, rest = (pc.binary_join_element_wise(*c, " ") if c else pa.array([""] * len(part), pa.string()) for c in (columns[:2], columns[2:]))
                yield pa.record_batch([langs.take(pa.array(part[:, 0])), head, rest, pa.array(counts[at : at + 20_000])], names=["lang", "head", "rest", "n"])

        for batch in batches:
            for lang, part in _by_language(batch):
                for _, data, offsets in slices(part, "_text", SLICE):
                    if len(words.keys) > MOST_IDS:
                        yield from rows()
                        words = Words()
                    data = LOWER[data]
                    first, last, code, on = piece_words(data, offsets)
                    code = mix(code ^ _salt(lang))
                    here = code
                    good = np.ones(len(code), bool)
                    if bits is not None:
                        whole = np.ones(len(code), bool)
                        for k in range(1, width - 1):  # hash and extent of the phrases of one word less
                            here = _fold(here[:-1], code[k:])
                            whole = whole[:-1] & on[k:]
                        at = here >> np.uint64(64 - bits[0])
                        known = whole & (bits[1][at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1) == 1)
                        good = known[:-1] & known[1:] & on[width - 1 :]
                    some = np.flatnonzero(good)
                    if not len(some):
                        continue
                    used = np.zeros(len(code), bool)
                    for k in range(width):
                        used[some + k] = True
                    number = np.zeros(len(code), np.int64)
                    number[used] = words.look_up(lang, code[used], data, first[used], last[used])
                    trie.add(*distinct_rows(np.stack([number[some + k] for k in range(width)], axis=1)))
                    if trie.total > held:
                        yield from rows(held // 2)
        yield from rows()

    return run


def _positions(width: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, part in _by_language(batch):
                for _, data, offsets in slices(part, "_text", SLICE):
                    code = mix(piece_words(data, offsets)[2] ^ _salt(lang)).reshape(-1, width)
                    here = code[:, 0]
                    for k in range(1, width):
                        here = _fold(here, code[:, k])
                    yield pa.record_batch([pa.array((here >> np.uint64(64 - bits)).astype(np.int64))], names=["at"])

    return run


def _bit_map(frequent: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """Bits of all frequent phrases, 32 to 64 bits a phrase as far as ``MOST_BITS`` allow; words of 64 bits."""
    many = frequent.count()
    bits = min(max(many, 1).bit_length() + 5, MOST_BITS)
    at = frequent.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_text")).mapInArrow(_positions(width, bits), "at bigint")
    block = at.groupBy(F.shiftright("at", 6).alias("block")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("ones"))
    got = block.toArrow()  # at most 2 ** (MOST_BITS - 6) rows
    out = np.zeros(max(1 << max(bits - 6, 0), 1), np.uint64)
    out[got.column("block").to_numpy()] = got.column("ones").to_numpy().view(np.uint64)
    return bits, out


def phrase_counts(docs: DataFrame, *, lang: str = "lang", text: str = "text", least: int = LEAST,
                  most_words: int = MOST_WORDS, held: int = HELD) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, n, n_words)`` of all phrases that occur ``least`` times or more, and ``(lang, n)`` of all words."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("_lang"), F.col(text).alias("_text"))
    levels, totals, sent = [], None, None
    for width in range(1, most_words + 1):
        runs = rows.mapInArrow(_runs(width, sent, held), "lang string, head string, rest string, n bigint")
        merged = runs.repartition("lang", "head").groupBy("lang", "head", "rest").agg(F.sum("n").alias("n"))
        phrase = F.when(F.col("rest") == "", F.col("head")).otherwise(F.concat_ws(" ", "head", "rest"))
        merged = merged.select("lang", phrase.alias("phrase"), "n")
        if width == 1:
            merged = stored(merged, "phrases-words")
            totals = merged.groupBy("lang").agg(F.sum("n").alias("n"))
        level = merged.where(F.col("n") >= least)
        level = stored(level.withColumn("n_words", F.lit(width)), f"phrases-{width}")
        levels.append(level)
        if sent is not None:
            sent.destroy()
        if width < most_words:
            sent = spark.sparkContext.broadcast(_bit_map(level, width))
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    return found, totals


def _exact(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def weakest_cuts(frequent: DataFrame) -> DataFrame:
    """``(lang, phrase, n_words, a, l, r, score)`` of each phrase of two words or more, at its cut of the lowest score."""
    parts = frequent.where("n_words > 1").withColumn("k", F.explode(F.expr("sequence(1, n_words - 1)")))
    parts = parts.select("lang", "phrase", "n_words", F.col("n").alias("a"), "k", F.expr("substring_index(phrase, ' ', k)").alias("first"),
                         F.expr("substring_index(phrase, ' ', k - n_words)").alias("rest"))
    left = frequent.select(F.col("lang").alias("lang1"), F.col("phrase").alias("first_"), F.col("n").alias("l"))
    right = frequent.select(F.col("lang").alias("lang2"), F.col("phrase").alias("rest_"), F.col("n").alias("r"))
    both = parts.join(left, (F.col("lang") == F.col("lang1")) & (F.col("first") == F.col("first_")))
    both = both.join(right, (F.col("lang") == F.col("lang2")) & (F.col("rest") == F.col("rest_")))
    both = both.withColumn("score", F.expr("CAST(a AS DECIMAL(20,0)) * 2000000BD DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))"))
    cut = both.groupBy("lang", "phrase", "n_words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return cut.select("lang", "phrase", "n_words", "a", "cut.l", "cut.r", "cut.score")


def without_contained(found: DataFrame, share: int = 80) -> DataFrame:
    """``found`` without phrases that stand inside a longer one with at least ``share`` percent of their count."""
    inside = F.expr(
        "flatten(transform(sequence(2, n_words - 1), m -> transform(sequence(1, n_words - m + 1),"
        " i -> array_join(slice(split(phrase, ' '), i, m), ' '))))"
    )
    longer = found.where("n_words > 2").select(F.col("lang").alias("lang_"), F.explode(inside).alias("inner"), F.col("a").alias("by"))
    longer = longer.groupBy("lang_", "inner").agg(F.max("by").alias("by"))
    kept = found.join(longer, (F.col("lang") == F.col("lang_")) & (F.col("phrase") == F.col("inner")), "left")
    return kept.where(F.col("by").isNull() | (_exact("by") * 100 < _exact("a") * share)).drop("lang_", "inner", "by")


def collocations(docs: DataFrame, *, lang: str = "lang", text: str = "text", least: int = LEAST, most_words: int = MOST_WORDS,
                 top: int = TOP, held: int = HELD) -> DataFrame:
    """Each language's ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score``."""
    frequent, totals = phrase_counts(docs, lang=lang, text=text, least=least, most_words=most_words, held=held)
    found = stored(without_contained(weakest_cuts(frequent)), "phrases-scored")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))  # a language is ranked in parts first, so no task takes all of it
    some = found.withColumn("salt", salt).withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
    some = some.where(F.col("place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
