import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lacuna.llm import classifier, ctw, queries
from tests.llm import brute


def words_text(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 4))) for _ in range(n))


# --- language model


def tree_by_hand(texts, depth):
    """Counts by (context, node) and the weighted probabilities of the whole training text, by the definition."""
    counts = {}
    for t in texts:
        raw = bytes([0xFF] * depth) + brute_lower(t) + b"\xff"
        for k in range(depth, len(raw)):
            node = 1
            for j in range(7, -1, -1):
                bit = raw[k] >> j & 1
                for d in range(depth + 1):
                    c = counts.setdefault((raw[k - d : k], node), [0, 0])
                    c[bit] += 1
                node = 2 * node + bit
    return counts


def brute_lower(t):
    return (t or "").translate(brute.LOW).encode()


def kt(c):
    return math.lgamma(c[0] + 0.5) + math.lgamma(c[1] + 0.5) - math.lgamma(sum(c) + 1) - math.log(math.pi)


def log10_by_hand(counts, text, depth):
    deeper = {}
    for (ctx, node), _ in counts.items():
        if ctx:
            deeper.setdefault((ctx[1:], node), []).append((ctx, node))
    weighted = {}

    def lw(key):
        if key not in weighted:
            own = kt(counts[key])
            if len(key[0]) == depth:
                weighted[key] = (own, 1.0)
            else:
                below = sum(lw(k)[0] for k in deeper.get(key, []))
                weighted[key] = (np.logaddexp(own, below) - math.log(2), 1 / (1 + math.exp(min(700.0, below - own))))
        return weighted[key]

    raw = bytes([0xFF] * depth) + brute_lower(text) + b"\xff"
    total = 0.0
    for k in range(depth, len(raw)):
        node = 1
        for j in range(7, -1, -1):
            bit = raw[k] >> j & 1
            path = [(raw[k - d : k], node) for d in range(depth + 1) if (raw[k - d : k], node) in counts]
            p, left = 0.0, 1.0
            for n, key in enumerate(path):
                one = (counts[key][1] + 0.5) / (sum(counts[key]) + 1)
                w = 1.0 if n == len(path) - 1 else lw(key)[1]
                p, left = p + left * w * one, left * (1 - w)
            p = p if path else 0.5
            total += math.log10(p if bit else 1 - p)
            node = 2 * node + bit
    return total


def test_scores_equal_the_definition(make):
    rng = random.Random(1)
    texts = [words_text(rng, rng.randrange(0, 40)) for _ in range(40)] + [None, "", "The END the\n\nend ", "zz unseen zz"]
    rows = ctw.score_documents(make([{"doc_id": k, "text": t} for k, t in enumerate(texts)]), frequent=20).collect()
    train = [t for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % 7 != 2]
    seen = {}
    for t in train:
        for w in [*brute.WORD.findall((t or "").translate(brute.LOW)), 0]:
            seen[w] = seen.get(w, 0) + 1
    total = sum(seen.values())
    tree = tree_by_hand(train, ctw.DEPTH)
    for r in rows:
        t = texts[r["doc_id"]]
        tokens = [*brute.WORD.findall((t or "").translate(brute.LOW)), 0]
        base = sum(math.log10((seen.get(w, 0) + 1) / (total + len(seen) + 1)) for w in tokens)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(w in seen for w in tokens), total)
        assert r["base_score"] == pytest.approx(base, abs=1e-6)
        assert r["score"] == pytest.approx(log10_by_hand(tree, t, ctw.DEPTH), rel=1e-6, abs=1e-5)


def test_scores_do_not_depend_on_what_tasks_hold(make):
    """Contexts that the tasks do not hold count as well: a head of a few runs gives the definition's scores."""
    rng = random.Random(2)
    texts = [words_text(rng, rng.randrange(0, 40)) for _ in range(40)] + ["zz unseen zz"]
    tree = tree_by_hand([t for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % 7 != 2], ctw.DEPTH)
    for r in ctw.score_documents(make([{"doc_id": k, "text": t} for k, t in enumerate(texts)]), nodes=8).collect():
        assert r["score"] == pytest.approx(log10_by_hand(tree, texts[r["doc_id"]], ctw.DEPTH), rel=1e-6, abs=1e-5)


def test_predictions_sum_to_one():
    """Whatever nodes are left out, the 256 next bytes share all probability."""
    rng = np.random.default_rng(0)
    tables = []
    for d in range(3):
        keys = np.unique(rng.integers(0, 1 << (8 * d), 300).astype(np.uint64) << np.uint64(8) | rng.integers(1, 256, 300).astype(np.uint64))
        tables.append((keys, rng.uniform(0.01, 0.99, len(keys))))
    for ctx in rng.integers(0, 1 << 16, 20):
        grams = (np.uint64(ctx) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert np.sum(10 ** ctw._log10_gram(grams, tables, 2)) == pytest.approx(1)


def test_scores_odd_tables(make):
    assert ctw.score_documents(make([])).count() == 0
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    r = ctw.score_documents(make([{"doc_id": held, "text": "ab"}])).first()
    assert r["held_out"] and r["n_known"] == 0 and r["train_tokens"] == 0 and r["score"] == pytest.approx(24 * math.log10(0.5))
    rows = ctw.score_documents(make([{"doc_id": None, "text": "a b"}, {"doc_id": None, "text": "a b"}, {"doc_id": 1, "text": "x " * 20_000}])).collect()
    assert len(rows) == 3 and len({r["score"] for r in rows if r["doc_id"] is None}) == 1


# --- classifier


def test_quality_learns_and_ignores_held_out_labels(make, spark):
    rng = random.Random(3)
    docs, labels = [], []
    for k in range(600):
        good = rng.random() < 0.7
        docs.append({"doc_id": k, "text": words_text(rng, 60) if good else " ".join(words_text(rng, 1) + "###" for _ in range(60))})
        labels.append((k, int(good)))
    df, schema = make(docs), "doc_id bigint, quality int"
    rows, at = classifier.quality_scores(df, spark.createDataFrame(labels, schema))
    got = {r["doc_id"]: r[at] for r in rows.collect()}
    held = [k for k in got if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum((got[k] >= 0.5) == bool(labels[k][1]) for k in held) >= 0.95 * len(held)
    flipped = [(k, 1 - y if k in held else y) for k, y in labels]
    again, at = classifier.quality_scores(df, spark.createDataFrame(flipped, schema))
    assert {r["doc_id"]: r[at] for r in again.collect()} == got


def test_quality_odd_tables(make, spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (99, 1)], "doc_id bigint, quality int")
    assert classifier.quality_scores(make([]), labels)[0].count() == 0
    extra = "doc_id bigint, text string, score string, y int, id int"
    rows, at = classifier.quality_scores(make([{"doc_id": 1, "text": "a b c"}, {"doc_id": 2}, {"doc_id": 2}, {"doc_id": 3, "text": ""}], extra), labels)
    assert at == "score_" and all(0 <= r[at] <= 1 for r in rows.collect())


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    z = rng.normal(0, 2, 20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-z))).astype(float)
    assert classifier.calibrate(3 * z, y) == pytest.approx(3, rel=0.1)


# --- pipeline and registered queries


def test_pipeline_stages(spark, sf, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    out = []
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        out.append(docs.collect())
        if k < 4:
            assert docs.columns == columns
    start = spark.read.parquet(f"{sf}/documents.parquet").collect()
    ruled, alone, clean, mixed, packed = out
    assert all(not brute.counts(r["text"])["base_failed"] for r in ruled) and len(ruled) < len(start)
    want = [c for (_, c), r in zip(brute.classes([(r["doc_id"], r["text"]) for r in ruled]), ruled)]
    assert sorted(r["doc_id"] for r in alone) == sorted(set(want))
    assert sorted(r["doc_id"] for r in clean) == sorted(r["doc_id"] for r in alone)
    assert not any(brute.base_spans(r["text"]) for r in clean)
    assert all(r["n_chars"] == len(r["text"]) for r in clean)
    assert set(mixed) <= set(clean)
    assert sorted(r["doc_id"] for r in packed if r["piece"] == 0) == sorted(r["doc_id"] for r in mixed)


def test_pipeline_stages_on_odd_tables(spark, sf):
    import corpus_pipeline as P

    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, mix int, n bigint"
    odd = spark.createDataFrame([(None, None, None, None, None, "r", 1, 2), (1, "", "en", "s", 0, "r", 1, 2), (1, "", "en", "s", 0, "r", 1, 2),
                                 (2, "good words here " * 9 + "token=abcdef12", None, None, 5, None, None, None)], schema)
    for name, stage in P.STAGES[:4]:
        assert stage(spark, odd, sf).columns == odd.columns
        assert stage(spark, odd.limit(0), sf).count() == 0, name
    assert P.STAGES[4][1](spark, odd, sf).count() == 4
    clean = {r["doc_id"]: r for r in P.secrets(spark, odd, sf).collect()}
    assert clean[2]["text"].endswith("here [SECRET]") and clean[2]["n_chars"] == len(clean[2]["text"])
    assert clean[None]["text"] is None and clean[None]["n_chars"] is None


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_with_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = sorted(c[0] for c in want.description)
    want = sorted(tuple(r[[c[0] for c in want.description].index(c)] for c in columns) for r in want.fetchall())
    df = queries.QUERIES[name](spark, sf)
    assert sorted(df.columns) == columns
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == want


def test_scoring_takes_small_slices(monkeypatch):
    """A scoring task's arrays are those of a small slice; scores do not depend on it."""
    texts = ["some words of text %d " % k * 60 for k in range(700)]
    batch = pa.record_batch([pa.array(range(700)), pa.array(range(700)), pa.array([False] * 700), pa.array(texts)], names=["doc_id", "uid", "held_out", "text"])
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    runs = np.unique(ctw._grams(data, np.r_[0, np.cumsum([len(t) for t in texts])])[0])
    sizes, grams = [], ctw._grams
    monkeypatch.setattr(ctw, "_grams", lambda d, o: sizes.append(len(d)) or grams(d, o))

    def scores():
        made = ctw._score(runs, np.linspace(-1, 0, len(runs)), np.zeros(0, np.uint64), np.zeros(0), 1.0)(iter([batch]))
        return np.concatenate([b.column(6).to_numpy() for b in made])

    small = scores()
    assert max(sizes) <= 1 << 18
    monkeypatch.setattr(ctw, "SLICE", 1 << 22)
    assert np.allclose(small, scores(), rtol=1e-8)


def test_counts_travel_a_bucket_a_row(monkeypatch):
    """A task passes its keys on side by side, not a row each; what places add up equals plain counts."""
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ab c"), 300)) for _ in range(40)]
    learn = rng.random(40) < 0.7
    monkeypatch.setattr(ctw, "HELD", 100)
    monkeypatch.setattr(ctw, "BUCKETS", 4)
    batch = pa.record_batch([pa.array(learn), pa.array(texts)], names=["learn", "text"])
    rows = pa.Table.from_batches(b for k in range(0, 40, 7) for b in ctw._count(iter([batch.slice(k, 7)])))
    assert rows.num_rows <= 6 * 12 * 20 and sum(len(k) for k in rows.column("keys").to_pylist()) // 8 > 3 * rows.num_rows
    run = pa.array(np.minimum(rows.column("kind").to_numpy(), 1).astype(np.int8))
    rows = rows.append_column("run", run).select(["run", "bucket", "kind", "keys", "counts"]).sort_by([("run", "ascending"), ("bucket", "ascending")])
    monkeypatch.setattr(ctw, "CHUNK", 9)
    got = [r for b in ctw._total(iter(rows.to_batches(max_chunksize=5))) for r in zip(*(c.to_pylist() for c in b.columns))]
    want = {}
    for some, t in zip(learn.tolist(), texts):
        raw = bytes([ctw.EDGE]) * ctw.DEPTH + t.encode() + bytes([ctw.EDGE])
        for k in range(len(t) + 1):  # the most recent context byte is the most significant one
            key = int.from_bytes(raw[k : k + ctw.DEPTH][::-1] + raw[k + ctw.DEPTH : k + ctw.DEPTH + 1], "big")
            n, m = want.get(key, (0, 0))
            want[key] = n + some, m + 1
    assert {r[1]: r[2:] for r in got if r[0] == 1} == want and len([r for r in got if r[0] == 1]) == len(want)
    assert sum(r[2] for r in got if r[0] == 0) == sum(len(t.split()) + 1 for some, t in zip(learn, texts) if some)
