import random

import numpy as np
import pyarrow as pa
import pytest

from lacuna.llm import jaccard, repeats, session
from tests.llm import brute


def near_corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6)))
    passage = [word() for _ in range(80)]
    docs = []
    for k in range(n):
        kind = rng.randrange(6)
        if kind == 0 or not docs:
            words = [word() for _ in range(rng.randrange(0, 120))]
        elif kind == 1:
            words = list(passage) + [word() for _ in range(rng.randrange(0, 30))]
        else:
            words = rng.choice(docs).split()
            for _ in range(rng.randrange(0, 4)):
                if words:
                    words[rng.randrange(len(words))] = word()
        docs.append((" " if rng.random() < 0.5 else "\n").join(words))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(make, seed):
    texts = near_corpus(seed, 150) + [None, "", "  ", "One two", "one TWO", "x"]
    docs = [(3 * k % 157, t) for k, t in enumerate(texts)]
    got = jaccard.jaccard_classes(make([{"doc_id": d, "text": t} for d, t in docs])).collect()
    want = {d: w for (d, t), w in zip(docs, brute.classes(docs))}
    for r in got:
        n, least = want[r["doc_id"]]
        assert (r["n_shingles"], r["component_id"]) == (n, least if n else r["doc_id"])
    assert len(got) == len(docs)


@pytest.mark.parametrize("common", [1, 6])
def test_common_shingles_move_back(make, monkeypatch, common):
    """Shingles of large regions stand last in every window; classes stay as they are."""
    texts = near_corpus(4, 150)
    docs = list(enumerate(texts))
    monkeypatch.setattr(jaccard, "COMMON", common)
    monkeypatch.setattr(jaccard, "PAIRS", 3)
    rows = make([{"doc_id": d, "text": t} for d, t in docs])
    assert jaccard._moved_back(rows.select("text")) is not None
    got = jaccard.jaccard_classes(rows).collect()
    want = {d: w for (d, _), w in zip(docs, brute.classes(docs))}
    assert all((r["n_shingles"], r["component_id"]) == (want[r["doc_id"]][0], want[r["doc_id"]][1] if r["n_shingles"] else r["doc_id"]) for r in got)


def test_common_order_keeps_rows(spark):
    values, start = jaccard.shingle_sets(*_arrays(["a b c d e f g h", "", "a b c d e f x y", "q"]))
    both = set(values[: start[1]]) & set(values[start[2] : start[3]])
    bits = jaccard._bit_set(spark.createDataFrame([(int(v.astype("int64")),) for v in both], "f bigint"))
    got = jaccard._ordered(values, start, bits)
    for k in range(4):
        row = got[start[k] : start[k + 1]]
        assert sorted(row) == sorted(values[start[k] : start[k + 1]])
        assert list(row) == sorted(row, key=lambda v: (v in both, v))


def _arrays(texts):
    data = "".join(texts).encode()
    return np.frombuffer(data, dtype=np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])


def test_links_equal_brute_force(make, monkeypatch):
    """Every row has its number of links, also those between points of one class and copies."""
    texts = near_corpus(3, 120) + [None, "", "One two", "one TWO"]
    docs = [(3 * k % 157, t) for k, t in enumerate(texts)]
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    got = jaccard.jaccard_classes(make([{"doc_id": d, "text": t} for d, t in docs]), links=True).collect()
    sets = [brute.shingles(t) for t in texts]
    many = {d: sum(k != j and bool(x) and 100 * len(x & y) >= 80 * len(x | y) for j, y in enumerate(sets)) for k, ((d, _), x) in enumerate(zip(docs, sets))}
    assert {r["doc_id"]: r["n_links"] for r in got} == many and max(many.values()) > 2
    want = {d: w for (d, _), w in zip(docs, brute.classes(docs))}
    assert all(r["component_id"] == (want[r["doc_id"]][1] if r["n_shingles"] else r["doc_id"]) for r in got)


@pytest.mark.parametrize("repeated", [False, True])
def test_groups_without_ids_keep_one_row(make, repeated):
    """Copies without an id go as well, whether or not another row stands twice."""
    words = [f"w{k}" for k in range(60)]
    near = " ".join([*words[:-1], "other"])
    rows = [(None, " ".join(words)), (None, " ".join(words)), (None, near), (None, ""), (None, None), (3, "a b c d e f"), (None, "a b c d e f"), (7, "alone in its class")]
    rows += [(7, "alone in its class")] * repeated
    got = jaccard.one_of_each_class(make([{"doc_id": d, "text": t} for d, t in rows])).collect()
    kept = [(r["doc_id"], r["text"] or "") for r in got]
    assert sorted(d for d, _ in kept if d is not None) == [3, 7]
    assert sorted(len(t) > 0 for d, t in kept if d is None) == [False, False, True]


def test_small_blocks_and_a_chain(make, monkeypatch):
    """Points that link only through others, and regions cut into blocks, give the same classes."""
    base = [f"w{k}" for k in range(100)]
    texts = []
    for step in range(12):  # each text differs from the one before in two words
        words = list(base)
        for k in range(step):
            words[8 * k] = f"x{k}"
        texts.append(" ".join(words))
    docs = list(enumerate(texts))
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_classes(make([{"doc_id": d, "text": t} for d, t in docs])).collect()}
    assert got == {d: w[1] for (d, _), w in zip(docs, brute.classes(docs))}


def test_jaccard_odd_tables(make, spark):
    assert jaccard.jaccard_classes(make([])).count() == 0
    rows = [{"doc_id": None, "text": "a b c d e f"}, {"doc_id": 4, "text": "a b c d e f"}, {"doc_id": 4, "text": "a b c d e f"}, {"doc_id": None, "text": None}]
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_classes(make(rows)).collect())
    assert got == [("4", 2, 4), ("4", 2, 4), ("None", 0, None), ("None", 2, 4)]
    extra = "doc_id bigint, text string, f bigint, n bigint, cell string, set_id string, _k int"
    kept = jaccard.one_of_each_class(make([{"doc_id": d, "text": t, "f": d} for d, t in ((1, "a b"), (2, "A  b"), (3, "c"))], extra))
    assert kept.columns == ["doc_id", "text", "f", "n", "cell", "set_id", "_k"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
    assert sorted(r["doc_id"] for r in jaccard.one_of_each_class(make(rows[1:3])).collect()) == [4]


def test_long_text(make):
    text = " ".join(f"w{k}" for k in range(60_000))
    got = jaccard.jaccard_classes(make([{"doc_id": 1, "text": text}, {"doc_id": 2, "text": text + " end"}])).collect()
    assert {(r["n_shingles"], r["component_id"]) for r in got} == {(59_996, 1), (59_997, 1)}


def repeat_corpus(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("ab é\n") for _ in range(n))
    passage = text(900)
    docs = [text(rng.randrange(0, 1500)) for _ in range(12)]
    for _ in range(12):
        a = rng.randrange(0, 500)
        cut = passage[a : a + rng.randrange(200, 700)]
        docs.append(text(rng.randrange(0, 300)) + cut + text(rng.randrange(0, 300)))
    docs += [docs[3], docs[14], passage, passage * 2, "z" * 1000, "ab" * 400, text(399), None, ""]
    edited = list(docs[13])
    edited[len(edited) // 2] = "#"
    return docs + ["".join(edited)]


@pytest.mark.parametrize("seed", [5, 6])
def test_repeats_equal_brute_force(make, seed):
    texts = repeat_corpus(seed)
    rows = repeats.remove_repeats(make([{"doc_id": k, "text": t} for k, t in enumerate(texts)])).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in rows}
    for k, want in enumerate(brute.repeats(texts)):
        assert got[k] == want, k


def test_repeats_odd_tables(make):
    assert repeats.remove_repeats(make([])).count() == 0
    text = "".join(chr(97 + k * k % 23) + str(k) for k in range(300))
    extra = "doc_id bigint, text string, k1 string, k2 string, found string, number int"
    rows = repeats.remove_repeats(make([{"doc_id": None, "text": text}, {"doc_id": 7, "text": text}, {"doc_id": 7, "text": text}, {"doc_id": 8}], extra)).collect()
    assert sorted(r["n_removed"] for r in rows) == [0, len(text), len(text), len(text)]
    alone = repeats.remove_repeats(make([{"doc_id": 1, "text": text}])).first()
    assert alone["n_removed"] == 0 and alone["spans"] == []


def test_large_groups_of_near_copies_make_few_pairs(make, monkeypatch):
    """Regions of a large group draw pivots, so few of its points are left to be paired with each other."""
    rng = random.Random(5)
    passage = [f"w{k}" for k in range(60)]
    docs = []
    for d in range(120):  # two edits each: about half of the pairs link, hardly any with the smallest
        words = list(passage)
        for k in range(3):
            words[rng.randrange(len(words))] = f"x{d}_{k}"
        docs.append((d, " ".join(words + [f"y{d}_{k}" for k in range(d % 7)])))
    paired, blocked = [], jaccard._blocked

    def counted(marked, points):
        rows = blocked(marked, points)
        paired.append(rows.count())
        return rows

    monkeypatch.setattr(jaccard, "CROWD", 4)
    monkeypatch.setattr(jaccard, "_blocked", counted)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_classes(make([{"doc_id": d, "text": t} for d, t in docs])).collect()}
    want = {d: w for (d, _), w in zip(docs, brute.classes(docs))}
    assert got == {d: least for d, (_, least) in want.items()}
    assert paired[0] < 4 * len(docs)


def test_small_sketches_bound_the_difference():
    """Half as many parities never differ in more classes than the sets in shingles, and set half-alike sets apart."""
    texts = [" ".join(f"w{k}" for k in range(300)), " ".join(f"{'w' if k < 200 else 'v'}{k}" for k in range(300))]
    values, start = jaccard.shingle_sets(*_arrays(texts))
    a, b = jaccard._folded(jaccard._parities(values, start)).view(np.uint64)
    apart = int(np.bitwise_count(a ^ b).sum())
    differ = len(set(values[: start[1]]) ^ set(values[start[1] :]))
    assert apart <= differ
    assert apart > (start[2] - 2 * -(-80 * start[2] // 180))


def test_signatures_hold_one_text_of_a_set():
    """Comparisons read the texts that stand beside the sets, so no later scan makes shingles of all texts again."""
    texts = ["a b c d e f", None, "a B c d e f", "", "x y", "a b c d e f"]
    batch = pa.record_batch([pa.array(range(6)), pa.array(texts)], names=["doc_id", "text"])
    rows = pa.Table.from_batches(jaccard._signatures(iter([batch.slice(0, 2), batch.slice(2)])))
    assert rows.column("text").to_pylist() == ["a b c d e f", None, None, None, "x y", None]
    assert len(set(rows.column("f").to_pylist())) == 3


def test_one_of_each_class_leaves_texts_in_the_jvm(make):
    """The last scans send workers eight bytes a text, and there are two of them; kept rows are those of the definition."""
    near = [f"w{k}" for k in range(60)]
    long, other = " ".join(near), " ".join([*near[:-1], "other"])
    rows = [(1, long), (2, other), (2, long), (1, long.upper()), (5, ""), (5, None), (5, " \t"), (6, " "), (None, ""), (None, " "), (None, None),
            (6, "alone"), (6, "alone"), (6, "Alone"), (8, "by itself"), (None, "x"), (None, "X")]
    got = jaccard.one_of_each_class(make([{"doc_id": d, "text": t} for d, t in rows]))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    evals = [line for line in plan.splitlines() if "ArrowEvalPython" in line]
    assert len(evals) == 2 and all("marked(key#" in line or "marked(xxhash64(" in line for line in evals)
    kept = [(r["doc_id"], (r["text"] or "").lower().strip()) for r in got.collect()]
    want = [(1, long), (5, ""), (6, ""), (None, ""), (None, ""), (None, ""), (6, "alone"), (8, "by itself"), (None, "x")]
    assert sorted(kept, key=repr) == sorted(want, key=repr)


def test_tables_are_made_in_small_batches(spark):
    """``stored`` bounds the rows that a worker is sent at once, and leaves the session as it was."""
    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows])], names=["n"])

    before = spark.conf.get(session.ROWS_AT_ONCE)
    rows = spark.range(0, 6000, 1, 1).mapInArrow(sizes, "n bigint")
    assert max(r["n"] for r in session.stored(rows, "sizes", 2000).collect()) == 2000
    assert spark.conf.get(session.ROWS_AT_ONCE) == before
    assert max(r["n"] for r in session.stored(rows, "sizes").collect()) == min(6000, int(before))
