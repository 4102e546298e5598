"""Language-model scores by context-tree weighting over bytes, with a word unigram as the base.

A byte is eight binary decisions.  For each context of the last 0 .. ``DEPTH`` bytes and each decision, all training
texts give counts of zeros and ones; a node's Krichevsky-Trofimov estimate depends on these counts alone, so the tree is
a matter of aggregation: runs of bytes are counted, shared out by their last ``SPLIT`` context bytes and summed upward.  From the deepest contexts upward, ``log P_w = log((KT + prod P_w(children)) / 2)``
and the node's weight ``KT / (KT + prod P_w(children))`` tells how much it counts against its deeper contexts.  A text's
probability is the product over its decisions of the mixture along its context path, from the root down.

A context and its next byte are a run of ``DEPTH + 1`` bytes, whose probability is that of its eight decisions.  It is
worked out once for each distinct run of all texts, in the task that holds the tree below the run's last ``SPLIT``
context bytes: no node is left out, and a path ends at the deepest context that training has seen.  Only the levels above
``SPLIT`` are sent to these tasks (at most ``256 ** (SPLIT - 1)`` contexts, whatever the input).  Whether a node is there
depends on what precedes the bit, never on the bit, so the model is a proper distribution.  Texts are closed by the byte
0xFF (which UTF-8 never uses), also the context before the first byte.

For scoring, the most frequent runs (at most ``NODES``) are sent to the tasks with their probability, and each text's
other runs meet theirs in a join, so the number sent decides the speed and no result.

Word counts of the base are exact: words of at least ``1 / FREQUENT`` of all tokens (so at most ``FREQUENT`` words) are
sent to the tasks, and each text's rarer words meet their counts in a join on the word's 64-bit hash.

Defined results: null is the empty text (one end token); rows with one id are scored each; a null id counts in the fold
of the text ``null``; without training rows every word is unknown and bits have probability one half; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import learns
from .session import ship, stored
from .text import LOWER, mix, per_row, slices, word_hashes, words

DEPTH = 6
NODES = 1 << 22  # runs that scoring tasks hold, 16 bytes each
FREQUENT = 1 << 16
HELD = 1 << 21  # distinct keys that a counting task holds before it passes them on
OFTEN = 8  # a key counted more often stays until the task ends, as long as such keys fill a quarter of that
BUCKETS = 1 << 14  # groups of keys that are counted in one place, their keys travelling side by side in one row
SPLIT = 3  # bytes of context by which the tree is shared out
CHUNK = 1 << 15  # runs that a tree-building task takes at once, more only within one group
SLICE = 1 << 18  # text bytes handled at once; numpy temporaries are about 200 bytes for each
TIMES = 1 << 16  # a run's frequency, as far as it is told apart

END = np.uint64(0x5E17E5A1D0C0FFEE)  # the end token's key among word hashes
EDGE = 0xFF


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word keys of all rows and each row's number of words."""
    first, last = words(data, offsets)
    return word_hashes(data, first, last), np.diff(per_row(first, offsets))


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte and each row's closing edge, its context and itself, packed; and the rows' ends.

    The most recent context byte is the most significant one, so sorted runs keep a context's extensions together.
    """
    n, size = len(offsets) - 1, np.diff(offsets)
    wide = DEPTH + 1
    padded = np.full(len(data) + wide * n, EDGE, dtype=np.uint8)
    row = np.repeat(np.arange(n), size)
    padded[np.arange(len(data)) + row * wide + DEPTH] = data
    m = len(padded) - DEPTH
    packed = np.zeros(max(m, 0), dtype=np.uint64)
    for back in range(1, wide):
        packed = (packed << np.uint64(8)) | padded[DEPTH - back : DEPTH - back + m]
    packed = (packed << np.uint64(8)) | padded[DEPTH:]
    starts = offsets[:-1] + np.arange(n) * wide
    keep = np.ones(len(packed), dtype=bool)  # windows that reach over a row's edge end in the next row's padding
    for k in range(DEPTH):
        keep[starts[1:] - 1 - k] = False
    return packed[keep], offsets[1:] + np.arange(1, n + 1)


def _buckets(kind: int, keys: np.ndarray) -> np.ndarray:
    """The bucket of each key: of a word by its hash, of a run by its last ``SPLIT`` context bytes."""
    spread = keys if kind == 0 else mix(keys >> np.uint64(8 * (DEPTH + 1 - SPLIT)))
    return (spread >> np.uint64(40)).astype(np.uint16) & np.uint16(BUCKETS - 1)


def _blobs(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    """The bytes of ``values``, cut at ``cut``."""
    return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer((cut * values.itemsize).astype(np.int32)), pa.py_buffer(values.tobytes())])


class _Counter:
    """Counts keys; passes most of its contents on when it holds many."""

    def __init__(self, kind: int):
        self.kind, self.keys, self.counts, self.size = kind, [], [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        k, n = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.counts.append(n)
        self.size += len(k)
        if self.size > HELD:
            self.merge()
            if self.size > HELD // 2:
                often = (self.counts[0] > OFTEN) & (self.counts[0] < 1 << 31)
                yield from self.flush(often if 4 * often.sum() <= HELD else np.zeros_like(often))

    def merge(self) -> None:
        if len(self.keys) > 1:
            keys, counts = _summed(np.concatenate(self.keys), np.concatenate(self.counts))
            self.keys, self.counts, self.size = [keys], [counts], len(keys)

    def flush(self, stay: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """All keys but those that ``stay``, side by side in a row of each bucket."""
        self.merge()
        if not self.size:
            return
        keys, counts = self.keys[0], self.counts[0]
        if stay is None:
            stay = np.zeros(len(keys), dtype=bool)
        self.keys, self.counts, self.size = [keys[stay]], [counts[stay]], int(stay.sum())
        keys, counts = keys[~stay], counts[~stay]
        bucket = _buckets(self.kind, keys)
        order = np.argsort(bucket, kind="stable")
        keys, counts, bucket = keys[order], counts[order].astype(np.uint32), bucket[order]
        cut = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(keys)] if len(keys) else np.zeros(1, np.int64)
        yield pa.record_batch([pa.array(np.full(len(cut) - 1, self.kind, dtype=np.int8)), pa.array(bucket[cut[:-1]].astype(np.int32)),
                               _blobs(keys, cut), _blobs(counts, cut)], names=["kind", "bucket", "keys", "counts"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys and numbers of training words (kind 0), training runs (1) and held-out runs (2); rows ``(learn, text)``."""
    tokens, grams, others = _Counter(0), _Counter(1), _Counter(2)
    for batch in batches:
        for rows, data, offsets in slices(batch, "text", SLICE):
            data, learn = LOWER[data], rows.column(0).to_numpy(zero_copy_only=False)
            keys, count = _tokens(data, offsets)
            yield from tokens.add(np.concatenate([keys[np.repeat(learn, count)], np.full(int(learn.sum()), END)]))
            runs, ends = _grams(data, offsets)
            seen = np.repeat(learn, np.diff(np.r_[0, ends]))
            yield from grams.add(runs[seen])
            yield from others.add(runs[~seen])
    yield from tokens.flush()
    yield from grams.flush()
    yield from others.flush()


def _flat(blobs: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows, one row after another, and where each row's begin (one more entry than rows)."""
    _, cut, body = blobs.buffers()
    wide = np.dtype(dtype).itemsize
    cut = np.frombuffer(cut, np.int32)[blobs.offset : blobs.offset + len(blobs) + 1] // wide
    values = np.frombuffer(body, dtype, int(cut[-1])) if body is not None else np.zeros(0, dtype)
    return values[cut[0] :], cut - cut[0]


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(run, key, n, m)``, each key once, from rows ``(run, bucket, kind, keys, counts)`` that come sorted.

    ``n`` counts the key in training, ``m`` in all texts.  What is held is a bucket's keys and a small slice of rows.
    """
    held: list[tuple[np.ndarray, ...]] = []
    last, most = -1, 0  # the last row's run and bucket, and the keys held after equal ones were added up

    def out(run: int) -> Iterator[pa.RecordBatch]:
        keys, n, m = _summed(*(np.concatenate(c) for c in zip(*held)))
        for a in range(0, len(keys), 1 << 17):
            k = keys[a : a + (1 << 17)]
            yield pa.record_batch([pa.array(np.full(len(k), run, dtype=np.int8)), pa.array(k.view(np.int64)),
                                   pa.array(n[a : a + (1 << 17)]), pa.array(m[a : a + (1 << 17)])], names=["run", "key", "n", "m"])

    for batch in batches:
        place = batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy()
        keys, cut = _flat(batch.column(3), "u8")
        m = _flat(batch.column(4), "u4")[0].astype(np.int64)
        n = m * np.repeat(batch.column(2).to_numpy() < 2, np.diff(cut))
        # slices of a run end where many keys do, or the run
        ends = np.flatnonzero(np.r_[(place[1:] >> 32 != place[:-1] >> 32) | (cut[1:-1] // CHUNK != cut[2:] // CHUNK), True]) + 1 if len(place) else []
        for lo, hi in zip([0, *ends], ends):
            new = lo + int(np.searchsorted(place[lo:hi], place[hi - 1]))  # where the slice's last bucket starts
            if held and place[lo] >> 32 != last >> 32:
                yield from out(last >> 32)
                held, most = [], 0
            if new > lo or place[lo] != last:  # the buckets before are complete
                held.append(tuple(c[cut[lo] : cut[new]] for c in (keys, n, m)))
                if sum(len(c[0]) for c in held) > CHUNK:
                    yield from out(int(place[lo] >> 32))
                    held = []
                most = 0
            held.append(tuple(c[cut[new] : cut[hi]] for c in (keys, n, m)))
            last = int(place[hi - 1])
            if sum(len(c[0]) for c in held) > 2 * most + HELD:
                held = [tuple(_summed(*(np.concatenate(c) for c in zip(*held))))]
                most = len(held[0][0])
    if held:
        yield from out(last >> 32)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log(gamma(x)) by Stirling's series at ``x + 8``."""
    y, shift = x + 8, x.copy()
    for k in range(1, 8):
        shift *= x + k
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    zeros, ones = zeros.astype(float), ones.astype(float)
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def _summed(keys: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """Distinct keys, ascending, and the sums of the columns over each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return [keys[at], *(np.add.reduceat(c[order], at) for c in columns)]


def _weighed(zeros: np.ndarray, ones: np.ndarray, deeper: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """log P_w of nodes and the weight of their own estimate; ``deeper``: the sum of their deeper contexts' log P_w."""
    kt = _log_kt(zeros, ones)
    if deeper is None:
        return kt, np.ones(len(kt))
    return np.logaddexp(kt, deeper) - np.log(2), 1 / (1 + np.exp(np.minimum(deeper - kt, 700.0)))


_NODES = ["depth", "key", "zeros", "ones", "lw", "w"]
_NODES_TYPE = "depth int, key bigint, zeros bigint, ones bigint, lw double, w double"


def _rows(depth: int, *columns: np.ndarray) -> pa.RecordBatch:
    key = columns[0]
    return pa.record_batch([pa.array(np.full(len(key), depth, dtype=np.int32)), pa.array(key.view(np.int64)), *(pa.array(c) for c in columns[1:])], names=_NODES)


def _subtree(depth: int, key: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """The nodes ``(key, zeros, ones, lw, w)`` of depth ``depth`` up to ``SPLIT``, level by level, from runs and counts."""
    ctx, byte = key >> np.uint64(8), key & np.uint64(255)
    cut = np.uint64(8 * (DEPTH - depth))  # contexts longer than asked for
    ctx = ctx >> cut
    nodes, zeros, ones = [], [], []
    for k in range(8):
        node = np.uint64(1 << k) + (byte >> np.uint64(8 - k))
        bit = ((byte >> np.uint64(7 - k)) & np.uint64(1)).astype(np.int64)
        x, one, all_ = _summed((ctx << np.uint64(8)) | node, n * bit, n)
        nodes.append(x)
        ones.append(one)
        zeros.append(all_ - one)
    nodes, zeros, ones, deeper = np.concatenate(nodes), np.concatenate(zeros), np.concatenate(ones), None
    for d in range(depth, SPLIT - 1, -1):
        if d < depth:
            up = ((nodes >> np.uint64(16)) << np.uint64(8)) | (nodes & np.uint64(255))
            nodes, zeros, ones, deeper = _summed(up, zeros, ones, lw)
        lw, w = _weighed(zeros, ones, deeper)
        yield nodes, zeros, ones, lw, w


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns ``(key, ...)`` in chunks, from rows that come sorted by key.

    Runs with the same ``SPLIT`` most recent bytes are neighbours; a chunk ends where such a group does.
    """
    held, size = [], 0
    for batch in batches:
        held.append([c.to_numpy() for c in batch.columns])
        size += batch.num_rows
        if size >= CHUNK:
            columns = [np.concatenate(c) for c in zip(*held)]
            group = columns[0].view(np.uint64) >> np.uint64(8 * (DEPTH + 1 - SPLIT))
            end = int(np.searchsorted(group, group[-1]))
            if end:
                yield [c[:end] for c in columns]
            held, size = [[c[end:] for c in columns]], size - end
    if size:
        yield [np.concatenate(c) for c in zip(*held)]


def _tops(depth: int):
    """The nodes of depth ``SPLIT``, from sorted runs ``(key, n)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n in _groups(batches):
            for top in _subtree(depth, key.view(np.uint64), n):
                pass
            yield _rows(SPLIT, *top)

    return run


def _valued(depth: int, upper: tuple[list, tuple], key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log10 probability of each of a chunk's runs, ascending; those with ``n = 0`` are no part of the tree."""
    seen = n > 0
    levels = [(x, zeros, ones, w) for x, zeros, ones, _, w in _subtree(depth, key[seen], n[seen])][::-1] if seen.any() else []
    return _log10_gram(key, upper[0] + predictors(levels, upper[1])[0])


def _by_group(grams: DataFrame, *columns: str) -> DataFrame:
    parts = grams.repartition(F.shiftright("key", 8 * (DEPTH + 1 - SPLIT)))
    return parts.sortWithinPartitions("key").select("key", *columns)


def context_tree(grams: DataFrame, depth: int = DEPTH) -> list[pa.Table]:
    """Tables by depth 0 .. ``SPLIT - 1``: ``(key, zeros, ones, w)`` of all nodes there, from training runs ``(key, n)``.

    A key is the context (most recent byte first) and the node: 1 for a byte's first bit, then ``2 * node + bit``.  ``w``
    is the weight of the node's own estimate against its deeper contexts, down to ``depth``.  Contexts of ``SPLIT`` bytes
    share out the runs; the levels above them are at most ``256 ** (SPLIT - 1)`` contexts.
    """
    level, out = stored(_by_group(grams, "n").mapInArrow(_tops(depth), _NODES_TYPE), "ctw-nodes"), {}
    for d in range(SPLIT - 1, -1, -1):
        node = F.col("key").bitwiseAND(255)
        up = F.shiftleft(F.shiftright("key", 16), 8).bitwiseOR(node)
        sums = level.groupBy(up.alias("key")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("lw").alias("deeper"))

        def weigh(zeros: pa.Array, ones: pa.Array, deeper: pa.Array) -> pa.Array:
            lw, w = _weighed(zeros.to_numpy(), ones.to_numpy(), deeper.to_numpy())
            return pa.StructArray.from_arrays([pa.array(lw), pa.array(w)], names=["lw", "w"])

        made = F.arrow_udf(weigh, "struct<lw:double,w:double>").asNondeterministic()("zeros", "ones", "deeper")
        level = sums.select(F.lit(d).alias("depth"), "key", "zeros", "ones", made.alias("m")).select("depth", "key", "zeros", "ones", "m.lw", "m.w")
        level = out[d] = stored(level, f"ctw-{d}")
    return [out[d].select("key", "zeros", "ones", "w").toArrow() for d in range(SPLIT)]


def run_values(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``(key, m, log)`` for each run ``(key, n, m)``: the log10 probability of its last byte after its context.

    ``n`` counts the run in training (0: it teaches nothing), ``m`` in all texts.
    """
    tops = [tuple(t.column(c).to_numpy() for c in range(4)) for t in context_tree(grams.where("n > 0"), depth)]
    shared = grams.sparkSession.sparkContext.broadcast(predictors([(k.view(np.uint64), *rest) for k, *rest in tops]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n, m in _groups(batches):
            logs = _valued(depth, shared.value, key.view(np.uint64), n)
            yield pa.record_batch([pa.array(key), pa.array(m), pa.array(logs)], names=["key", "m", "log"])

    return stored(_by_group(grams, "n", "m").mapInArrow(run, "key bigint, m bigint, log double"), "ctw-runs")


def predictors(levels: list[tuple[np.ndarray, ...]], above: tuple[np.ndarray, ...] | None = None) -> tuple[list, tuple | None]:
    """For each level ``(key, zeros, ones, w)``, sorted node keys and the probability of a one where the path ends there.

    From the root down, ``made`` sums the weighted estimates so far and ``left`` is the weight not yet given; ``above``
    has the nodes over the first level with these two, and so has the second result for the levels that follow.
    """
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for keys, zeros, ones, w in levels:
        order = np.argsort(keys)
        keys, zeros, ones, w = keys[order], zeros[order].astype(float), ones[order].astype(float), w[order]
        kt = (ones + 0.5) / (zeros + ones + 1.0)
        if above is None:
            made, left = np.zeros(len(keys)), np.ones(len(keys))
        else:  # the parent's key: without the oldest byte
            at = np.searchsorted(above[0], ((keys >> np.uint64(16)) << np.uint64(8)) | (keys & np.uint64(255)))
            made, left = above[1][at], above[2][at]
        out.append((keys, made + left * kt))
        above = (keys, made + left * w * kt, left * (1 - w))
    return out, above


def _log10_gram(grams: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray]], depth: int = DEPTH) -> np.ndarray:
    """log10 probability of each packed run's last byte after its context; sorted runs make the look-ups local."""
    byte, ctx = grams & np.uint64(255), grams >> np.uint64(8)
    total = np.zeros(len(grams))
    for k in range(8):
        node = np.uint64(1 << k) + (byte >> np.uint64(8 - k))
        one = (byte >> np.uint64(7 - k)) & np.uint64(1)
        p = np.full(len(grams), 0.5)
        open_ = np.arange(len(grams))
        for d in range(len(tables) - 1, -1, -1):
            keys, probs = tables[d]
            if not len(keys) or not len(open_):
                continue
            want = ((ctx[open_] >> np.uint64(8 * (depth - d))) << np.uint64(8)) | node[open_]
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            hit = keys[at] == want
            p[open_[hit]] = probs[at[hit]]
            open_ = open_[~hit]
        total += np.log10(np.where(one == 1, p, 1 - p))
    return total


def _lists(row: np.ndarray, keys: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
    """For each of ``n`` rows, its distinct keys and how often it has each."""
    order = np.lexsort((keys, row))
    r, k = row[order], keys[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    start = np.flatnonzero(new)
    many = np.diff(np.r_[start, len(k)])
    cut = pa.array(np.r_[0, np.cumsum(np.bincount(r[start], minlength=n))].astype(np.int32))
    return pa.ListArray.from_arrays(cut, pa.array(k[start].view(np.int64))), pa.ListArray.from_arrays(cut, pa.array(many.astype(np.int32)))


def _met(keys: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``want`` are among the sorted ``keys``, and the places of those."""
    if not len(keys):
        return np.zeros(len(want), dtype=bool), np.zeros(0, dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    known = keys[at] == want
    return known, at[known]


def _score(runs: np.ndarray, values: np.ndarray, keys: np.ndarray, counts: np.ndarray, denominator: float):
    """Scores by what the tasks hold (runs and words, both sorted); what is not there is listed for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text", SLICE):
                data = LOWER[data]
                n = len(offsets) - 1
                grams, ends = _grams(data, offsets)
                distinct, back = np.unique(grams, return_inverse=True)
                known, at = _met(runs, distinct)
                log = np.zeros(len(distinct))
                log[known] = values[at]
                logs = np.r_[0, np.cumsum(log[back])]
                score = logs[ends] - logs[np.r_[0, ends[:-1]]]
                # sums over long slices lose digits: about 1e-9 of a text's score, the same in every run
                far = np.flatnonzero(~known[back])
                far, far_times = _lists(np.searchsorted(ends, far, side="right"), grams[far], n)
                tokens, count = _tokens(data, offsets)
                row = np.repeat(np.arange(n), count)
                row, tokens = np.r_[row, np.arange(n)], np.r_[tokens, np.full(n, END)]
                known, at = _met(keys, tokens)
                base = np.bincount(row[known], weights=np.log10((counts[at] + 1) / denominator), minlength=n).astype(float)
                seen = np.bincount(row[known], minlength=n)
                rare, times = _lists(row[~known], tokens[~known], n)
                yield pa.record_batch([
                    rows.column(0), rows.column(1), rows.column(2), pa.array(count + 1), pa.array(seen), pa.array(base), pa.array(score),
                    rare, times, far, far_times,
                ], names=["doc_id", "uid", "held_out", "n_tokens", "n_known", "base", "score", "rare", "times", "far", "far_times"])

    return run


def _sorted(table: pa.Table, value: str) -> tuple[np.ndarray, np.ndarray]:
    keys, values = table.column("key").to_numpy().view(np.uint64), table.column(value).to_numpy().astype(float)
    order = np.argsort(keys)
    return keys[order], values[order]


def _least(values: DataFrame, size: int, nodes: int) -> float:
    """The least frequency ``m`` that at most ``nodes`` runs have or exceed; ``size``: the sum of all."""
    bound = max(1.0, size / nodes)  # the runs from here on fit in any case
    times = values.groupBy(F.least("m", F.lit(TIMES)).alias("m")).count().toArrow()  # at most TIMES rows
    m, runs = times.column("m").to_numpy(), times.column("count").to_numpy()
    order = np.argsort(m)[::-1]
    fit = m[order][np.cumsum(runs[order]) <= nodes]
    return min(bound, float(fit[-1])) if len(fit) else bound


def score_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", modulus: int = 7, held: int = 2,
                    depth: int = DEPTH, nodes: int = NODES, frequent: int = FREQUENT) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, scores as log10 probabilities.

    Learns from the rows outside the fold ``crc32(id as text) mod modulus = held`` and scores all.  ``depth`` is at
    least ``SPLIT`` and at most ``DEPTH``.
    """
    spark = docs.sparkSession
    ship(spark)
    learn = learns(doc_id, modulus, held)
    counted = docs.select(learn.alias("learn"), F.col(text).cast("string").alias("text")).mapInArrow(_count, "kind tinyint, bucket int, keys binary, counts binary")
    # a task's keys travel a bucket at a time: single rows of them cost more than all else
    dealt = counted.select(F.least("kind", F.lit(1)).cast("tinyint").alias("run"), "bucket", "kind", "keys", "counts").repartition("run", "bucket")
    counts = stored(dealt.sortWithinPartitions("run", "bucket").mapInArrow(_total, "run tinyint, key bigint, n bigint, m bigint"), "ctw-counts")
    token, gram = counts.where("run = 0").select("key", "n"), counts.where("run = 1").select("key", "n", "m")
    total, kinds = token.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    size = gram.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    denominator = float(total + kinds + 1)

    values = run_values(gram, depth)
    common = F.col("m") >= _least(values, size, nodes)
    head = _sorted(values.where(common).select("key", "log").toArrow(), "log")  # at most `nodes` runs
    least = max(1.0, total / frequent)
    top = _sorted(token.where(F.col("n") >= least).toArrow(), "n")  # at most `frequent` words
    shared = spark.sparkContext.broadcast((*head, *top))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _score(*shared.value, denominator)(batches)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("uid"), (~learn).alias("held_out"), F.col(text).cast("string").alias("text"))
    schema = (
        f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, uid bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, "
        "rare array<bigint>, times array<int>, far array<bigint>, far_times array<int>"
    )
    first = stored(rows.mapInArrow(run, schema), "ctw-scores")

    def listed(keys: str, times: str) -> DataFrame:
        return first.select("uid", F.explode(F.arrays_zip(keys, times)).alias("x")).select("uid", F.col(f"x.{keys}").alias("key"), F.col(f"x.{times}").alias("times"))

    met = listed("rare", "times").join(token.where(F.col("n") < least), "key", "left")
    log = F.log10((F.coalesce(F.col("n"), F.lit(0)) + 1.0) / F.lit(denominator))
    more = met.groupBy("uid").agg(F.sum(F.col("times") * log).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("seen"))
    deep = listed("far", "far_times").join(values.where(~common).select("key", "log"), "key")
    deep = deep.groupBy("uid").agg(F.sum(F.col("times") * F.col("log")).alias("deep"))
    return first.drop("rare", "times", "far", "far_times").join(more, "uid", "left").join(deep, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(int(total)).cast("bigint").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("deep", F.lit(0.0))).alias("score"),
    )
