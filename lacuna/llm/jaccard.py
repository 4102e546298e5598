"""Exact Jaccard join of documents on word 5-shingles, as a metric-space join over pivots.

Jaccard distance is a metric, and so is the size of the symmetric difference; documents link at a distance of at most
1 - ``percent`` / 100.  Documents with equal sets are one point.

Regions.  The pivots of the first level are single shingles in one common order: by hash, those that many windows hold
behind all others.  A point is as near to each of its own shingles as to any other and at distance 1 from all else, so
its Voronoi region is that of its first shingle, ties going by the order.  Two linked points differ in few shingles, so a point reaches over its region's border only to its first
``n / 5 + 1`` pivots: that window is replicated, and every linked pair meets in some region.  (Whole documents as
first-level pivots leave almost all points at distance 1 from every pivot, and their windows would be the whole table.)
Any common order keeps the windows exact.  Regions of shingles that many documents share (licences, templates) would
grow with the corpus; they are counted first, and a bit set of the largest ones moves them back in every window, so
such documents meet at rarer shingles, if at all.

Inside a region the join recurses on documents.  Its smallest point is the pivot; the others whose size, place and
sketches (lower bounds of the symmetric difference, by the triangle inequality) allow a link are compared with it
exactly, and those within the radius join its class.  The same is done once more with one point of each class, and
regions that still hold many classes draw other pivots, each its own.  A region whose points are all in one class is
done, which ends large groups of near copies after few comparisons for each point.  Points of different classes in what
is left are paired in blocks of bounded size, pruned by the same windows, and compared exactly.  Classes are the
connected components of all links, found by contraction.

Where the links themselves are asked for, no pair may be left out because its points are in one class: all points of a
region are paired in the blocks, and no balls are made.

Exactness rests on 64-bit hashes of shingles and of sets.  Defined results: a text with fewer than five words is one
shingle of its whole sequence; a text without words (or null) has no shingle and is a class of its own; a class is named
by its smallest id (null only if no member has one); repeated rows are in one class; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import ship, stored
from .text import LOWER, mix, signed, slices, windows, word_hashes, words

WIDTH = 5
PERCENT = 80
BITS = 2048  # parities of a point's large sketch; the small one has half as many
BLOCK = 2048  # points of a region that one task pairs with each other
GROUP = 1024  # points whose texts are compared in one place (two such blocks where more hang together)
PAIRS = 8192  # pairs of two such blocks that one task compares
FILTER_BITS = 22  # a bit set of this many address bits tells tasks which texts are needed
COMMON = 32  # points beyond which a region's shingle may move back in the order
MOVED = 1 << 18  # shingles that move back in a round, the commonest ones
ROUNDS = 2  # how often regions are counted, the later times those of the windows that have changed
COUNTED = 1 << 16  # a region's size, as far as it is told apart
CROWD = 64  # classes beyond which a region draws pivots before its points are paired
DRAWS = 3  # how often it does, as long as that finds links
WORD = r"[^\x20\x09-\x0D]"  # what a text with words holds
SEEN = 1 << 18  # sets that a task remembers
SLICE = 1 << 18  # text bytes handled at once
TEXTS = 2048  # rows of texts that a Python worker is sent at once; the JVM and the worker hold several copies of them


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, ascending within a row, and each row's first one (one more entry than rows)."""
    n = len(offsets) - 1
    data = LOWER[data]
    first, last = words(data, offsets)
    hashes = word_hashes(data, first, last)
    start = np.searchsorted(first, offsets)
    count = np.diff(start)
    row = np.repeat(np.arange(n), count)
    runs = windows(hashes, width)
    whole = np.flatnonzero(row[: len(runs)] == row[width - 1 :]) if len(runs) else np.zeros(0, dtype=np.int64)
    values, rows = [runs[whole]], [row[whole]]
    for k in range(1, width):  # short texts: the sequence as it is
        short = np.flatnonzero(count == k)
        if len(short):
            parts = windows(hashes, k)[start[:-1][short]]
            values.append(mix(parts + np.uint64(k)))
            rows.append(short)
    value, row = np.concatenate(values), np.concatenate(rows)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(n + 1))


def set_ids(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A 64-bit identifier of each row's set (0 for an empty one)."""
    full = np.flatnonzero(np.diff(start))
    out = np.zeros(len(start) - 1, dtype=np.uint64)
    if len(full):
        a = np.add.reduceat(mix(values + np.uint64(0x51ED270B)), start[:-1][full])
        b = np.add.reduceat(mix(values ^ np.uint64(0xC2B2AE3D27D4EB4F)), start[:-1][full])
        out[full] = mix(a + mix(b) + np.diff(start)[full].astype(np.uint64)) | np.uint64(1 << 63)
    return out


def _parities(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether an odd number of a set's shingles fall into each of ``BITS`` classes, packed.

    Each shingle of a symmetric difference turns one bit, so two sets differ in at least as many shingles as their
    parities differ in bits.
    """
    n = len(start) - 1
    row = np.repeat(np.arange(n), np.diff(start))
    out = []
    for a in range(0, n, 512):
        lo, hi = start[a], start[min(n, a + 512)]
        rows = min(n, a + 512) - a
        at = (row[lo:hi] - a) * BITS + ((values[lo:hi] >> np.uint64(20)) & np.uint64(BITS - 1)).astype(np.int64)
        odd = (np.bincount(at, minlength=rows * BITS) & 1).astype(np.uint8).reshape(rows, BITS)
        out.append(np.packbits(odd, axis=1))
    return np.concatenate(out) if out else np.zeros((0, BITS // 8), dtype=np.uint8)


def _folded(parity: np.ndarray) -> np.ndarray:
    """Parities of half as many classes, each the union of two: still at most the symmetric difference apart."""
    half = parity.shape[1] // 2
    return parity[:, :half] ^ parity[:, half:]


def _binary(rows: np.ndarray) -> pa.Array:
    body = np.ascontiguousarray(rows)
    width = body.shape[1] * body.itemsize
    return pa.Array.from_buffers(pa.binary(), len(body), [None, pa.py_buffer((np.arange(len(body) + 1) * width).astype(np.int32)), pa.py_buffer(body.tobytes())])


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's set with its size and sketches; the text stands beside the first row of a set that a task meets.

    Columns after the text are passed on.
    """
    seen: set[int] = set()
    for batch in batches:
        for rows, data, offsets in slices(batch, "text", SLICE):
            values, start = shingle_sets(data, offsets)
            parity, f, n = _parities(values, start), set_ids(values, start), np.diff(start)
            text = rows.column(1).take(pa.array(np.arange(len(n)), mask=~_unseen(f, n, seen)))
            yield pa.record_batch([rows.column(0), pa.array(n), pa.array(signed(f)), _binary(_folded(parity)), _binary(parity), text, *rows.columns[2:]],
                                  names=["doc_id", "n", "f", "sketch", "parity", "text", *rows.schema.names[2:]])


def _ordered(values: np.ndarray, start: np.ndarray, moved: np.ndarray | None) -> np.ndarray:
    """Shingles in the common order, row by row; those of the bit set ``moved`` come last."""
    if moved is None:
        return values
    back = _marked(moved, values)
    count = np.r_[0, np.cumsum(back)]
    own = count[start[1:]] - count[start[:-1]]
    size = np.diff(start)
    before = count[:-1] - np.repeat(count[start[:-1]], size)
    to = np.where(back, np.repeat(start[1:] - own, size) + before, np.arange(len(values)) - before)
    out = np.empty_like(values)
    out[to] = values
    return out


def _window(n: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of the first ``n / 5 + 1`` shingles of the rows ``which``, of sizes ``n``."""
    reach = np.where(which, n - -(-n * PERCENT // 100) + 1, 0)
    row = np.repeat(np.arange(len(n)), reach)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(reach) - reach, reach)


def _unseen(f: np.ndarray, n: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which rows have a set that ``seen`` lacks, adding these: most copies in one task count once."""
    if len(seen) > SEEN:
        seen.clear()
    new = np.zeros(len(f), dtype=bool)
    for k, v in enumerate(f.tolist()):
        if n[k] and v not in seen:
            seen.add(v)
            new[k] = True
    return new


def _windows(moved):
    """``(cell, f, np)`` for the window of each set; ``np`` packs size and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, data, offsets in slices(batch, "text", SLICE):
                values, start = shingle_sets(data, offsets)
                f, n = set_ids(values, start), np.diff(start)
                row, place = _window(n, _unseen(f, n, seen))
                values = _ordered(values, start, moved and moved.value)
                yield pa.record_batch([pa.array(signed(values[start[:-1][row] + place])), pa.array(signed(f[row])), pa.array(n[row] << 32 | place)],
                                      names=["cell", "f", "np"])

    return run


def _cells(moved):
    """The last 32 bits of the cells of windows: of all sets, or of those whose window a shingle has moved out of.

    Sizes decide the order alone, so cells that agree in these bits may count as one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, data, offsets in slices(batch, "text", SLICE):
                values, start = shingle_sets(data, offsets)
                f, n = set_ids(values, start), np.diff(start)
                row, place = _window(n, _unseen(f, n, seen))
                if moved:
                    changed = np.zeros(len(n), dtype=bool)
                    changed[row[_marked(moved.value, values[start[:-1][row] + place])]] = True
                    values = _ordered(values, start, moved.value)
                    row, place = _window(n, changed)
                yield pa.record_batch([pa.array(values[start[:-1][row] + place].astype(np.uint32).view(np.int32))], names=["cell"])

    return run


def _common(least: int):
    """``(cell, c)`` for cells that come more than ``least`` times; they come sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, times = 0, 0
        for batch in batches:
            cell = batch.column(0).to_numpy()
            if not len(cell):
                continue
            first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            keys, count = cell[first], np.diff(np.r_[first, len(cell)])
            if times and keys[0] == last:
                count[0] += times
            elif times:
                keys, count = np.r_[np.int32(last), keys], np.r_[times, count]
            last, times = int(keys[-1]), int(count[-1])
            many = np.flatnonzero(count[:-1] > least)
            yield pa.record_batch([pa.array(keys[many]), pa.array(count[many])], names=["cell", "c"])
        if times > least:
            yield pa.record_batch([pa.array([last], type=pa.int32()), pa.array([times])], names=["cell", "c"])

    return run


def _moved_back(texts: DataFrame) -> np.ndarray | None:
    """A bit set of the shingles that stand behind all others in the common order; none if no region is large."""
    bits, sc = None, texts.sparkSession.sparkContext
    for _ in range(ROUNDS):
        shared = None if bits is None else sc.broadcast(bits)
        cells = texts.mapInArrow(_cells(shared), "cell int").repartition("cell").sortWithinPartitions("cell")
        sizes = stored(cells.mapInArrow(_common(COMMON), "cell int, c bigint"), "jaccard-common", TEXTS)
        if shared is not None:
            shared.destroy()
        held = sizes.groupBy(F.least("c", F.lit(COUNTED)).alias("c")).agg(F.count("*").alias("cells")).toArrow()  # at most COUNTED rows
        if not held.num_rows:
            break
        c, cells_ = held.column("c").to_numpy(), held.column("cells").to_numpy()
        order = np.argsort(-c)
        fit = int((np.cumsum(cells_[order]) <= MOVED).sum())
        least = int(c[order][max(fit - 1, 0)])
        found = _bit_set(sizes.where(F.col("c") >= least).select(F.col("cell").alias("f")))
        bits = found if bits is None else bits | found
    return bits


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Points of regions with two or more, each beside the region's pivot; rows come sorted by cell, size and set.

    One row is held back between batches, and the pivot of a region that goes on, so a region of any size streams.
    """
    names = ["cell", "f", "np", "pivot", "pivot_np"]
    held: np.ndarray | None = None  # the last row seen, and its region's pivot: cell, f, np, pivot, pivot_np, shown
    for batch in batches:
        cell, f, sizes = _columns(batch)
        if held is not None:
            cell, f, sizes = np.r_[held[0], cell], np.r_[held[1], f], np.r_[held[2], sizes]
        if not len(cell):
            continue
        new = np.ones(len(cell), dtype=bool)
        new[1:] = (cell[1:] != cell[:-1]) | (f[1:] != f[:-1])
        at = np.flatnonzero(new)
        cell, f, sizes = cell[at], f[at], sizes[at]
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        run = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(cell)]))
        pivot, pivot_np = f[first][run], sizes[first][run]
        many = np.bincount(run)
        if held is not None:
            goes_on = run == 0
            pivot[goes_on], pivot_np[goes_on] = held[3], held[4]
            if held[5]:
                many[0] += 1
        shown = many[run] > 1
        keep = shown.copy()
        if held is not None and held[5]:
            keep[0] = False  # it was passed on with the batch before
        held = np.array([cell[-1], f[-1], sizes[-1], pivot[-1], pivot_np[-1], int(shown[-1])], dtype=np.int64)
        yield pa.record_batch([pa.array(c[keep]) for c in (cell, f, sizes, pivot, pivot_np)], names=names)


def _reachable(n1: np.ndarray, p1: np.ndarray, n2: np.ndarray, p2: np.ndarray) -> np.ndarray:
    """Whether two sets that first meet at these places can still share enough."""
    least = -(-PERCENT * (n1 + n2) // (100 + PERCENT))
    return np.minimum(n1 - p1, n2 - p2) >= least


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of points of different classes within a block of a region that the windows allow.

    Rows ``(cell, part, f, np, class, sketch)`` come sorted by cell, part and size; a part is one block or two.
    """
    rest: pa.Table | None = None

    def join(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        cell, part, f, sizes, group, block = (rows.column(c).to_numpy() for c in ("cell", "part", "f", "np", "class", "block"))
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), dtype=np.uint64).reshape(-1, BITS // 128)
        n, place = sizes >> 32, sizes & 0xFFFFFFFF
        i = np.arange(len(cell))
        for step in range(1, len(cell)):
            i = i[i < len(cell) - step]
            j = i + step
            near = (cell[i] == cell[j]) & (part[i] == part[j]) & (n[j] * PERCENT <= n[i] * 100)
            i = i[near]  # sizes ascend: beyond the first row that is too large, all are
            if not len(i):
                return
            j = i + step
            ok = (group[i] != group[j]) & _reachable(n[i], place[i], n[j], place[j])
            # a part of two blocks pairs across them only
            ok &= (part[i] < 0) | (block[i] != block[j])
            a, b = i[ok], j[ok]
            for k in range(0, len(a), 1 << 17):
                x, y = a[k : k + (1 << 17)], b[k : k + (1 << 17)]
                apart = np.bitwise_count(sketch[x] ^ sketch[y]).sum(axis=1, dtype=np.int64)
                total = n[x] + n[y]
                fit = apart <= total - 2 * (-(-PERCENT * total // (100 + PERCENT)))
                if fit.any():
                    x, y = f[x[fit]], f[y[fit]]
                    yield pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        key = np.stack([table.column("cell").to_numpy(), table.column("part").to_numpy()])
        if not table.num_rows:
            continue
        same = np.flatnonzero((key != key[:, -1:]).any(axis=0))
        cut = int(same[-1]) + 1 if len(same) else 0
        rest = table.slice(cut)
        if cut:
            yield from join(table.slice(0, cut).combine_chunks().to_batches()[0])
    if rest is not None and rest.num_rows:
        yield from join(rest.combine_chunks().to_batches()[0])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sets share enough: the exact comparison.

    Rows come sorted by group and kind: a group's texts ``(a, text)`` first, then its pairs ``(a, b)``.  One group's sets
    are held at a time.
    """
    group, sets = None, {}
    for batch in batches:
        keys = np.stack([batch.column(k).to_numpy() for k in range(4)])
        kind, a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in (4, 5, 6))
        cuts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0) | (kind[1:] != kind[:-1])]) if len(kind) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(kind)]):
            own = tuple(keys[:, lo].tolist())
            if own != group:
                group, sets = own, {}
            if kind[lo] == 0:
                at = lo
                for rows, data, offsets in slices(batch.slice(lo, hi - lo), "text", SLICE):
                    values, start = shingle_sets(data, offsets)
                    for k in range(rows.num_rows):
                        sets[int(a[at + k])] = values[start[k] : start[k + 1]].copy()
                    at += rows.num_rows
                continue
            keep = []
            for k in range(lo, hi):
                x, y = sets[int(a[k])], sets[int(b[k])]
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                if 100 * both >= PERCENT * (len(x) + len(y) - both):
                    keep.append(k)
            yield pa.record_batch([pa.array(a[keep].astype(np.int64)), pa.array(b[keep].astype(np.int64))], names=["a", "b"])


def components(links: DataFrame, tag: str = "jaccard") -> DataFrame:
    """``(node, root)`` for every node of the undirected links ``(a, b)``; the root is the component's least node.

    Contraction: each node points to its least neighbour, pointers are doubled, and links between roots are what is
    left for the next round; a path halves at least each round.
    """
    spark = links.sparkSession
    known: DataFrame | None = None
    left = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{tag}-links")
    while not left.isEmpty():
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root"))
        point = stored(point, f"{tag}-points")
        for _ in range(2):
            up = point.select(F.col("node").alias("root"), F.col("root").alias("above"))
            point = point.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
        point = stored(point, f"{tag}-points")
        pa_, pb = point.select(F.col("node").alias("a"), F.col("root").alias("ra")), point.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = left.join(pa_, "a").join(pb, "b").where("ra <> rb")
        left = stored(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), f"{tag}-links")
        if known is None:
            known = point
        else:
            over = point.select(F.col("node").alias("root"), F.col("root").alias("above"))
            known = stored(known.join(over, "root", "left").select("node", F.coalesce("above", "root").alias("root")), f"{tag}-known")
    return known if known is not None else spark.createDataFrame([], "node bigint, root bigint")


def _bit_set(sets: DataFrame) -> np.ndarray:
    """Packed bits of the last ``FILTER_BITS`` of the hashes ``f``: a filter of bounded size for scans."""
    bits = sets.select(F.col("f").bitwiseAND((1 << FILTER_BITS) - 1).alias("k")).distinct().toArrow()  # at most 2 ** FILTER_BITS
    flags = np.zeros(1 << FILTER_BITS, dtype=bool)
    flags[bits.column("k").to_numpy()] = True
    return np.packbits(flags)


def _marked(bits: np.ndarray, f: np.ndarray) -> np.ndarray:
    at = (f & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


class _Comparer:
    """Exact comparisons of candidate pairs; fetches each text that it needs once, from ``held``, rows ``(f, text)``."""

    def __init__(self, held: DataFrame, points: DataFrame):
        self.held, self.points = held, points
        self.texts: DataFrame | None = None

    def near(self, pairs: DataFrame) -> DataFrame:
        """The pairs ``(a, b)`` that sizes and parities allow, written once."""
        side = lambda c: self.points.select(F.col("f").alias(c), F.col("n").alias(f"n{c}"), F.col("parity").alias(f"p{c}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        ok = F.arrow_udf(_close, "boolean")("pa", "pb", F.col("na") + F.col("nb"))
        return stored(both.where(ok).select("a", "b"), "jaccard-near")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs that link, written once.

        Pairs that hang together are compared in one place, so a text travels once and not for each of its pairs; where
        more than ``GROUP`` points hang together, they are dealt into blocks, and a place holds two blocks; where these
        have more than ``PAIRS`` pairs, the pairs are dealt over several places.
        """
        pairs = self.near(pairs)
        self._fetch(pairs.select(F.col("a").alias("f")).union(pairs.select("b")).distinct())
        together = components(pairs, "jaccard-together")
        blocks = together.groupBy("root").agg(F.ceil(F.count("*") / F.lit(GROUP)).cast("bigint").alias("blocks"))
        placed = pairs.join(together.select(F.col("node").alias("a"), "root"), "a").join(blocks, "root")
        i, j = (F.pmod(F.xxhash64(c), F.col("blocks")) for c in ("a", "b"))
        placed = stored(placed.select("root", F.least(i, j).alias("i"), F.greatest(i, j).alias("j"), "a", "b"), "jaccard-placed")
        place = ["root", "i", "j"]
        sizes = placed.groupBy(*place).agg(F.ceil(F.count("*") / F.lit(PAIRS)).cast("bigint").alias("deals"))
        many = sizes.where("deals > 1")
        placed = placed.join(many, place, "left").withColumn("deal", F.coalesce(F.pmod(F.xxhash64("a", "b"), F.col("deals")), F.lit(0))).drop("deals")
        place.append("deal")
        ends = placed.select(*place, F.col("a").alias("f")).union(placed.select(*place, "b")).distinct().join(self.texts, "f")
        none = F.lit(None)
        rows = ends.select(*place, F.lit(0).alias("kind"), F.col("f").alias("a"), F.lit(0).cast("bigint").alias("b"), "text").unionByName(
            placed.select(*place, F.lit(1).alias("kind"), "a", "b", none.cast("string").alias("text")))
        rows = rows.repartition(*place).sortWithinPartitions(*place, "kind")
        return stored(rows.mapInArrow(_linked, "a bigint, b bigint"), "jaccard-links", TEXTS)

    def _fetch(self, sets: DataFrame) -> None:
        """One text of each set that is not there yet, by a scan that passes on only rows whose set may be wanted."""
        if self.texts is not None:
            sets = stored(sets.join(self.texts, "f", "left_anti"), "jaccard-wanted")
            if sets.isEmpty():
                return
        shared = self.held.sparkSession.sparkContext.broadcast(_bit_set(sets))

        def wanted(f: pa.Array) -> pa.Array:
            return pa.array(_marked(shared.value, f.to_numpy().view(np.uint64)))

        found = self.held.where(F.arrow_udf(wanted, "boolean").asNondeterministic()("f"))
        found = stored(found.join(sets, "f", "left_semi").dropDuplicates(["f"]), "jaccard-texts", TEXTS)
        shared.destroy()
        self.texts = found if self.texts is None else self.texts.unionByName(found)


def _close(a: pa.Array, b: pa.Array, total: pa.Array) -> pa.Array:
    """Whether two parities allow a link of two sets with ``total`` shingles together."""
    if not len(a):
        return pa.array([], type=pa.bool_())
    x, y = (np.frombuffer(b"".join(c.to_pylist()), dtype=np.uint64).reshape(-1, BITS // 64) for c in (a, b))
    n = total.to_numpy()
    return pa.array(np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= n - 2 * (-(-PERCENT * n // (100 + PERCENT))))


def _balls(cells: DataFrame) -> DataFrame:
    """Distinct pairs of a region's pivot and another point that sizes and places allow."""
    n, p = F.shiftright("np", 32), F.col("np").bitwiseAND(0xFFFFFFFF)
    n0, p0 = F.shiftright("pivot_np", 32), F.col("pivot_np").bitwiseAND(0xFFFFFFFF)
    least = F.ceil(F.lit(PERCENT) * (n + n0) / F.lit(100 + PERCENT))
    star = cells.where("f <> pivot").where((n * PERCENT <= n0 * 100) & (n0 * PERCENT <= n * 100) & (F.least(n - p, n0 - p0) >= least))
    return star.select(F.least("f", "pivot").alias("a"), F.greatest("f", "pivot").alias("b")).distinct()


def _between(marked: DataFrame, order: Column, least: int) -> DataFrame:
    """One point of each class of a region, the first by ``order``, beside the first of all, where a region has more than ``least`` classes."""
    ones = marked.groupBy("cell", "class").agg(F.min(F.struct(order.alias("o"), "f", "np")).alias("x"))
    heads = ones.groupBy("cell").agg(F.min("x").alias("y"), F.count("*").alias("c")).where(F.col("c") > least)
    return ones.join(heads, "cell").select("x.f", "x.np", F.col("y.f").alias("pivot"), F.col("y.np").alias("pivot_np"))


def _blocked(marked: DataFrame, points: DataFrame) -> DataFrame:
    """Distinct pairs of points of different classes that meet in a region, from rows ``(cell, f, np, class)``."""
    mixed = marked.groupBy("cell").agg(F.min("class").alias("x"), F.max("class").alias("y"), F.count("*").alias("c")).where("x <> y")
    blocks = F.ceil(F.col("c") / F.lit(BLOCK)).cast("int")
    open_ = marked.join(mixed.select("cell", blocks.alias("blocks")), "cell").join(points.select("f", "sketch"), "f")
    open_ = open_.withColumn("block", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("f"), F.col("blocks"))).otherwise(0).cast("int"))
    # a region of several blocks: each block alone (-1 - block) and with each other block (low * blocks + high)
    others = F.transform(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != F.col("block")),
                         lambda k: (F.least(k, F.col("block")).cast("bigint") * F.col("blocks") + F.greatest(k, F.col("block"))))
    parts = F.concat(F.array((-1 - F.col("block")).cast("bigint")), others)
    open_ = open_.withColumn("part", F.explode(parts)).select("cell", "part", "f", "np", "class", "sketch", "block")
    open_ = open_.repartition("cell", "part").sortWithinPartitions("cell", "part", "np")
    return open_.mapInArrow(_pairs, "a bigint, b bigint").distinct()


def _partners(links: DataFrame, signs: DataFrame) -> DataFrame:
    """``(f, partners)``: for each set, the number of rows whose sets link with it, those of its own set included."""
    rows = signs.where("n > 0").groupBy("f").agg(F.count("*").alias("c"))
    both = links.select(F.col("a").alias("f"), F.col("b").alias("g")).union(links.select("b", "a"))
    others = both.join(rows.select(F.col("f").alias("g"), "c"), "g").select("f", "c")
    return others.union(rows).groupBy("f").agg(F.sum("c").alias("partners"))


def jaccard_classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", links: bool = False) -> DataFrame:
    """``(doc_id, n_shingles, component_id, set_id)`` for every row; ``set_id`` identifies the row's set of shingles.

    ``links=True`` adds ``n_links``, the number of other rows that the row links with, copies of its set included (0
    without words); the links between sets ``(a, b)`` stay in the shared folder as ``jaccard-links``.
    """
    return _rooted(docs, doc_id, text, links).drop("root", "key")


def _text(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def _rooted(docs: DataFrame, doc_id: str, text: str, links: bool = False) -> DataFrame:
    """The rows of ``jaccard_classes`` with ``root``, a set that names the class (null without words), and a ``key`` of the text."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), _text(text).alias("text")).withColumn("key", F.xxhash64("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    signs = rows.mapInArrow(_signatures, f"doc_id {kind}, n bigint, f bigint, sketch binary, parity binary, text string, key bigint")
    signs = stored(signs, "jaccard-signs", TEXTS)
    points = stored(signs.where("n > 0").groupBy("f").agg(F.min("n").alias("n"), F.min("sketch").alias("sketch"), F.min("parity").alias("parity")), "jaccard-sets")
    comparer = _Comparer(signs.where("text IS NOT NULL").select("f", "text"), points)

    moved = _moved_back(rows.select("text"))
    shared = None if moved is None else docs.sparkSession.sparkContext.broadcast(moved)
    cells = rows.select("text").mapInArrow(_windows(shared), "cell bigint, f bigint, np bigint")
    cells = cells.repartition("cell").sortWithinPartitions("cell", "np", "f")
    cells = stored(cells.mapInArrow(_regions, "cell bigint, f bigint, np bigint, pivot bigint, pivot_np bigint"), "jaccard-regions", TEXTS)
    if shared is not None:
        shared.destroy()
    if links:
        found = comparer.links(_blocked(cells.select("cell", "f", "np", F.col("f").alias("class")), points))
        return _named(signs, components(found), _partners(found, signs))
    found = comparer.links(_balls(cells))
    classes = components(found)

    def marked(cells: DataFrame) -> DataFrame:
        named = cells.select("cell", "f", "np").join(classes.select(F.col("node").alias("f"), "root"), "f", "left")
        return named.select("cell", "f", "np", F.coalesce("root", "f").alias("class"))

    # once more on one point of each class in a region: what lies between the balls of a group joins them
    more = comparer.links(_balls(_between(marked(cells), F.col("np"), 1)))
    if not more.isEmpty():
        found = found.union(more)
        classes = components(found)

    # a large group of near copies may link with few of its smallest points: its regions draw a pivot each, so every point
    # meets as many as it has regions, and the pairs grow with the points and not with their square
    large = cells.groupBy("cell").agg(F.count("*").alias("c")).where(F.col("c") > CROWD).select("cell")
    crowd = stored(cells.select("cell", "f", "np").join(large, "cell", "left_semi"), "jaccard-crowd")
    for k in range(DRAWS):
        drawn = stored(_between(marked(crowd), F.xxhash64(F.lit(k), "cell", "f"), CROWD), "jaccard-drawn")
        if drawn.isEmpty():
            break
        more = comparer.links(_balls(drawn))
        if more.isEmpty():
            break
        found = found.union(more)
        classes = components(found)

    # what is left: regions with points of several classes
    more = comparer.links(_blocked(stored(marked(cells), "jaccard-marked"), points))
    if not more.isEmpty():
        classes = components(found.union(more))
    return _named(signs, classes)


def _named(signs: DataFrame, classes: DataFrame, partners: DataFrame | None = None) -> DataFrame:
    """Each row with the least id of its class and, where ``partners`` is given, its number of links."""
    of_set, extra = classes.select(F.col("node").alias("f"), "root"), []
    if partners is not None:
        of_set, extra = partners.join(of_set, "f", "left"), [F.coalesce(F.col("partners") - 1, F.lit(0)).alias("n_links")]
    named = signs.select("doc_id", "n", "f", "key").join(of_set, "f", "left")
    named = stored(named.select("doc_id", "n", "f", "key", F.when(F.col("n") > 0, F.coalesce("root", "f")).alias("root"), *extra), "jaccard-named")
    least_id = named.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    out = named.join(least_id, "root", "left")
    return out.select("root", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"), F.col("f").alias("set_id"), *(["n_links"] if extra else []), "key")


def one_of_each_class(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of linked documents: that with the smallest id, of several the one with the smallest set.

    A group without any id keeps one row too; rows that are alike in id and set stay once.  A text without words is a
    group of its own, so of these only rows with the same id go.
    """
    classes = _rooted(docs, doc_id, text).where("root IS NOT NULL OR doc_id IS NOT NULL")
    lone = F.when(F.col("root").isNull(), F.col("doc_id")).alias("lone")  # without words, the id names the group
    classes = stored(classes.select("root", lone, "doc_id", "set_id", "key"), "jaccard-classes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "set_id", "key")).alias("x")
    groups = stored(classes.groupBy("root", "lone").agg(first, F.count("*").alias("c")), "jaccard-keep")
    keep = groups.select(F.col("x.doc_id").alias("_k"), F.col("x.key").alias("_t"))
    # rows whose text is in no class of several need no join, and their texts no shuffle
    many = groups.where("c > 1").select(F.col("root").alias("_r"), F.col("lone").alias("_l"))
    several = classes.join(many, F.col("root").eqNullSafe(F.col("_r")) & F.col("lone").eqNullSafe(F.col("_l")), "left_semi")
    shared = docs.sparkSession.sparkContext.broadcast(_bit_set(several.select(F.col("key").alias("f"))))

    def marked(keys: pa.Array) -> pa.Array:
        return pa.array(_marked(shared.value, keys.to_numpy().view(np.uint64)))

    # the texts stay in the JVM: a worker sees eight bytes of each
    mark = F.arrow_udf(marked, "boolean").asNondeterministic()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).alias("id"), _text(text).alias("t"))
    rows = rows.select("row", "id", F.xxhash64("t").alias("key"), (F.col("id").isNull() & ~F.col("t").rlike(WORD)).alias("nameless"))
    rows = rows.withColumn("grouped", mark("key") & ~F.col("nameless"))
    named = rows.where("grouped").join(keep, F.col("id").eqNullSafe(F.col("_k")) & (F.col("key") == F.col("_t")), "left_semi")
    return named.dropDuplicates(["id", "key"]).unionByName(rows.where("NOT grouped")).select("row.*")
