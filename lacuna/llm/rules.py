"""Quality rules with an isolation forest over the rules' statistics.

Each document gets a handful of counts (words, symbols, repeated lines, repeated 8-word windows, ...).  Fixed base rules
fail it outright; beyond them an isolation forest, grown on a bounded sample of the distinct statistics of all
documents, scores how few random splits set it apart, and rows above a threshold are rejected.  The threshold comes
from a histogram of the scores of all labelled rows: the one that parts the labels best among those that keep at least
``keep`` of the good ones.

Sampling distinct statistics keeps a large group of copies from passing as the norm.  The model (a few hundred KB) is
all that the driver holds; scoring reads each text once more and needs no join.

Defined results: null or word-less text has zero counts and fails the base rules; labels of rows that are not there are
ignored, and of contradicting labels of one id the lowest counts; without usable labels nothing but the base rules
rejects; repeated rows get equal verdicts; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import fresh
from .session import ship, stored
from .text import mix, per_row, prefix_sums, slices, span_hash, windows, words

TREES = 100
SAMPLE = 256  # distinct rows for each tree, as in the published method
KEEP = 0.995
BINS = 2000
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8

# fixed values of the base rules
SYMBOLS = b"#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_letters", "n_digits", "n_stops")

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC0:] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?,;:")] = True


def _distinct(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct hashes in each of ``n`` rows."""
    _, at = np.unique(mix(hashes + mix(rows.astype(np.uint64))), return_index=True)
    return np.bincount(rows[at], minlength=n)


def text_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All of ``COUNTS`` for each row of a slice of texts."""
    n, size = len(offsets) - 1, len(data)

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.r_[0, np.cumsum(flags, dtype=np.int64)]
        return sums[offsets[1:]] - sums[offsets[:-1]]

    first, last = words(data, offsets)
    count = np.diff(per_row(first, offsets))
    row = np.repeat(np.arange(n), count)
    sums = prefix_sums(data)
    hashes = span_hash(sums, first, last)
    chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)]
    out = {
        "n_words": count, "word_chars": np.bincount(row, weights=chars[last] - chars[first], minlength=n).astype(np.int64),
        "n_symbols": total(_SYMBOL[data]), "n_upper": total(_UPPER[data]), "n_letters": total(_LETTER[data]),
        "n_digits": total(_DIGIT[data]), "n_stops": total(_STOP[data]), "n_distinct": _distinct(row, hashes, n),
    }

    breaks = np.flatnonzero(data == 10)
    start = np.unique(np.r_[offsets[:-1], breaks + 1])
    start = start[start < size]
    home = np.searchsorted(offsets, start, side="right") - 1
    end = np.minimum(np.r_[breaks, size][np.searchsorted(breaks, start)], offsets[home + 1])
    full = np.searchsorted(first, end) > np.searchsorted(first, start)
    start, end, home = start[full], end[full], home[full]
    out["n_lines"] = np.bincount(home, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - _distinct(home, span_hash(sums, start, end), n)

    runs = windows(hashes, WINDOW)
    covered = np.zeros(len(first) + 1, dtype=np.int64)
    if len(runs):
        at = np.flatnonzero(row[: len(runs)] == row[WINDOW - 1 :])
        _, back, times = np.unique(mix(runs[at] + mix(row[at].astype(np.uint64))), return_inverse=True, return_counts=True)
        twice = at[times[back] > 1]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + WINDOW, -1)
    repeated = np.cumsum(covered)[:-1] > 0
    out["n_repeat_words"] = np.bincount(row, weights=repeated, minlength=n).astype(np.int64)
    return out


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """Size-free statistics of the rules, one row a document; rounded, so equal counts give equal rows."""
    w, lines, letters = (np.maximum(c[k], 1).astype(float) for k in ("n_words", "n_lines", "n_letters"))
    cols = [
        c["word_chars"] / w, np.minimum(c["n_symbols"] / w, 2.0), c["n_dup_lines"] / lines, c["n_repeat_words"] / w,
        c["n_upper"] / letters, c["n_digits"] / w, c["n_stops"] / w, (c["n_distinct"] / w) * np.log1p(w) / 6.0,
    ]
    return np.round(np.stack(cols, axis=1), 4)


def _average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, dtype=float)
    m = np.maximum(n, 2.0)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m))


@dataclass
class Forest:
    """Trees in flat arrays: ``feature`` -1 marks a leaf, whose ``cut`` is its path length."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    roots: np.ndarray
    scale: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """``2 ** (-mean path / expected path)``: near 1 for rows that few splits set apart."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while (inner := self.feature[node] >= 0).any():
                r, k = rows[inner], node[inner]
                node[inner] = np.where(x[r, self.feature[k]] < self.cut[k], self.left[k], self.right[k])
            total += self.cut[node]
        return np.exp2(-total / max(1, len(self.roots)) / self.scale)


def grow_forest(x: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = 7) -> Forest:
    """An isolation forest over the rows of ``x`` (a bounded sample), the same for the same rows in the same order."""
    rng = np.random.default_rng(seed)
    nodes: list[list[float]] = []
    roots = []
    size = min(sample, len(x))
    limit = int(np.ceil(np.log2(max(size, 2))))

    def grow(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append([-1, depth + float(_average_path(len(rows))), 0, 0])
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        open_ = np.flatnonzero(high > low)
        if depth < limit and len(rows) > 1 and len(open_):
            f = int(rng.choice(open_))
            cut = float(rng.uniform(low[f], high[f]))
            cut = cut if cut > low[f] else float(high[f])
            below = x[rows, f] < cut
            nodes[at] = [f, cut, grow(rows[below], depth + 1), grow(rows[~below], depth + 1)]
        return at

    for _ in range(trees if len(x) else 0):
        roots.append(grow(rng.choice(len(x), size, replace=False), 0))
    table = np.array(nodes, dtype=float).reshape(-1, 4)
    return Forest(table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), np.array(roots, dtype=int), max(1.0, float(_average_path(size))))


@dataclass
class RuleModel:
    forest: Forest
    threshold: float


def _judge(model: RuleModel | None) -> Callable[[pa.Array], pa.Array]:
    def run(texts: pa.Array) -> pa.Array:
        parts = [text_counts(data, offsets) for _, data, offsets in slices(pa.record_batch([texts], names=["t"]), "t")]
        c = {k: np.concatenate([np.zeros(0, np.int64), *(p[k] for p in parts)]).astype(np.int64) for k in COUNTS}
        score = model.forest.scores(features(c)) if model else np.zeros(len(texts))
        failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
        cols = [pa.array(c[k]) for k in COUNTS]
        cols += [pa.array(failed), pa.array(score), pa.array(~failed & (score <= model.threshold if model else True))]
        return pa.StructArray.from_arrays(cols, names=[*COUNTS, "base_failed", "score", "kept"])

    return run


_STRUCT = "struct<" + ",".join(f"{k}:bigint" for k in COUNTS) + ",base_failed:boolean,score:double,kept:boolean>"


def judged(text: Column | str, model: RuleModel | None) -> Column:
    """One struct for each text: all counts, ``base_failed``, ``score`` and ``kept``."""
    # not deterministic in name only: Catalyst then never evaluates it a second time for a filter
    return F.arrow_udf(_judge(model), _STRUCT).asNondeterministic()(text)


def fit_rules(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
              trees: int = TREES, sample: int = SAMPLE, keep: float = KEEP) -> RuleModel:
    """Grows the forest on about ``trees * sample`` distinct rows, and sets the threshold by all labelled rows."""
    ship(docs.sparkSession)
    stats = stored(docs.select(F.col(doc_id).alias("id"), judged(F.col(text), None).alias("c")), "rules-counts")
    vectors = stats.select("c").distinct()
    most = trees * sample
    n = vectors.count()
    key = F.xxhash64("c")
    share = min(1.0, most / max(n, 1))
    drawn = vectors.where((F.shiftrightunsigned(key, 11) / float(1 << 53)) < share) if share < 1 else vectors
    rows = sorted(tuple(r["c"][k] for k in COUNTS) for r in drawn.collect())
    x = features({k: np.array([r[j] for r in rows], dtype=np.int64) for j, k in enumerate(COUNTS)})
    forest = grow_forest(x, trees, sample)
    marks = labels.where(F.col(label).isNotNull()).groupBy(F.col(labels.columns[0] if doc_id not in labels.columns else doc_id).alias("id")).agg(F.min(label).alias("y"))

    def score(counts: pa.Array) -> pa.Array:
        c = {k: counts.field(k).to_numpy(zero_copy_only=False) for k in COUNTS}
        return pa.array(forest.scores(features(c)))

    scored = stats.where(~F.col("c.base_failed")).join(marks, "id").select("y", F.arrow_udf(score, "double")("c").alias("s"))
    found = scored.groupBy("y", F.floor(F.col("s") * BINS).cast("int").alias("b")).count().collect()
    good, bad = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for r in found:
        (good if r["y"] else bad)[min(max(r["b"], 0), BINS)] += r["count"]
    if not good.sum() or not bad.sum():
        return RuleModel(forest, float("inf"))
    passed, caught = np.cumsum(good) / good.sum(), 1 - np.cumsum(bad) / bad.sum()
    ok = passed >= keep
    best = int(np.argmax(np.where(ok, passed + caught, -1.0)))
    return RuleModel(forest, (best + 1) / BINS)


def quality_rules(docs: DataFrame, labels: DataFrame, *, text: str = "text", **options) -> tuple[DataFrame, str]:
    """``docs`` with a struct column of all counts and the verdict; returns it and the column's name."""
    model = fit_rules(docs, labels, text=text, **options)
    at = fresh("rules", docs.columns)
    return docs.withColumn(at, judged(F.col(text), model)), at
