"""Directly addressable ids, collocations and token alignment against plain versions."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers as P

from lacuna.llm import addressable, alignment, collocations, queries, units

BYTES, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [*"ab  \n\t　\xa0é日本語's.,12\x00\x85 ß🙂", " the", " of", "▁", "<|endoftext|>", "<s>", "<0x41>"]


def odd_texts(n, seed=5, odd=ODD):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(odd, k=rnd.randint(0, 30))) for _ in range(n)]


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=lambda t: tuple((x is not None, x) for x in t))


# -- 11: directly addressable codes ----------------------------------------------------------------------------------


def brute_ids(docs):
    """(id, n_tokens, crc) by the library on whole texts, ids ascending, nulls first, and the ids before each."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTES)
    out = []
    for d, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    return sorted(out, key=lambda r: (r[0] is not None, r[0]))


@pytest.mark.parametrize("values", [[0], [255, 256, 65535, 65536, 2**32 - 1], [7] * 1000, list(range(0, 70000, 3))])
def test_image_gives_any_id(values):
    ids = np.array(values, np.uint32)
    cut = sorted({1, len(ids) // 2, len(ids)} - {0})
    got = addressable.Image(addressable.image(ids, np.array(cut), [None, "", "é"][: len(cut)]))
    places = np.random.default_rng(1).integers(0, len(ids), 500)
    assert (got.ids(places) == ids[places]).all()
    for a, b in zip([0, *cut], [*cut, len(ids)]):
        assert (got.span(a, b) == ids[a:b]).all()
    assert (np.concatenate([got.document(k) for k in range(len(cut))]) == ids).all()
    assert got.names() == [None, "", "é"][: len(cut)]
    with pytest.raises(IndexError):
        got.ids(np.array([len(ids)]))


def test_image_refuses_other_files():
    with pytest.raises(ValueError):
        addressable.Image(b"PAR1" * 20)


def test_units_give_the_library_ids_of_whole_texts():
    model = addressable.Encoder(BYTES)
    assert model.cut
    for texts in ([t] for t in odd_texts(400)):
        data = np.frombuffer(texts[0].encode(), np.uint8)
        ids, _ = model.encode(data, np.array([0, len(data)]))
        assert ids.tolist() == model.tokenizer.encode(texts[0], add_special_tokens=False).ids


def test_addressable_query_equals_whole_encoding(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = rows_of(queries.op11_addressable(spark, sf), "doc_id", "start", "n_tokens", "ids_crc32")
    start, want = 0, []
    for d, n, crc in brute_ids(docs):
        want.append((d, start, n, crc))
        start += n
    assert got == want


def test_addressable_odd_rows(make):
    texts = [None, "", "x" * 300_000, "a b " * 40_000, *odd_texts(60)]
    rows = [{"doc_id": None if k % 9 == 0 else k % 20, "text": t} for k, t in enumerate(texts)] + [{"doc_id": 3, "text": "same"}] * 5
    docs = make([r | {"start": 1, "_name": "n"} for r in rows], "doc_id bigint, text string, start bigint, _name string")
    images = addressable.write_ids(docs, BYTES, image_ids=50)
    assert images.count() > 3
    got = rows_of(addressable.read_documents(images), "doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted((r[0] or -1, r[2], r[3]) for r in got) == sorted((d or -1, n, c) for d, n, c in brute_ids([(r["doc_id"], r["text"]) for r in rows]))
    assert [r[1] for r in sorted(got, key=lambda r: r[1])] == list(np.r_[0, np.cumsum([r[2] for r in sorted(got, key=lambda r: r[1])])[:-1]])
    places = sorted(got, key=lambda r: r[1])
    assert [r[0] or -1 for r in places] == sorted(r[0] or -1 for r in places)
    names = make([{"doc_id": "b", "text": "x"}, {"doc_id": "a", "text": "y"}], "doc_id string, text string")
    assert [r[0] for r in rows_of(addressable.read_documents(addressable.write_ids(names, BYTES), "string"), "doc_id", "start")] == ["a", "b"]
    none = make([], "doc_id bigint, text string")
    assert addressable.read_documents(addressable.write_ids(none, BYTES)).count() == 0


# -- 12: collocations ------------------------------------------------------------------------------------------------


def brute_phrases(docs, least, top=2000, share=80):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = collections.Counter(), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = collections.defaultdict(list)
    for p, a in found.items():
        cuts = [(2000000 * a // (f[p[: 1 + k]] + f[(p[0], *p[1 + k :])]), k) for k in range(1, len(p) - 1)]
        score, k = min(cuts)
        inside = any(q[0] == p[0] and len(q) > len(p) and any(q[i : i + len(p) - 1] == p[1:] for i in range(1, len(q)))
                     and 100 * b >= share * a for q, b in found.items())
        if not inside:
            out[p[0]].append((-score, -a, " ".join(p[1:]).encode(), f[p[: 1 + k]], f[(p[0], *p[1 + k :])]))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -score)
                  for lang, rows in out.items() for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1))


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def phrase_docs(seed=3, many=200):
    rnd = random.Random(seed)
    words = [*"abcdefgh", "É", "ß", "\x1cq", "of the"]
    docs = []
    for _ in range(many):
        text = "".join(rnd.choice(words).upper() + rnd.choice([" ", " ", " ", " ", "\t", "  ", ". ", "\n", ",", "　"]) for _ in range(rnd.randint(0, 40)))
        docs.append({"lang": rnd.choice(["en", "en", "de", None, ""]), "text": text, "n": 5})
    return docs + [{"lang": "en", "text": None}, {"lang": None, "text": ""}] + [{"lang": "de", "text": "one two three four five"}] * 12


@pytest.mark.parametrize("held", [collocations.HELD, 40])
def test_collocations_equal_brute_force(make, held):
    docs = phrase_docs()
    df = make(docs, "lang string, text string, n bigint").repartition(3)
    got = collocations.collocations(df, least=6, held=held)
    assert tuple(got.columns) == COLUMNS
    want = brute_phrases([(d["lang"], d["text"]) for d in docs], 6)
    assert len(want) > 50
    assert rows_of(got, *COLUMNS) == want
    few = collocations.collocations(df, least=6, top=4)
    assert rows_of(few, *COLUMNS) == brute_phrases([(d["lang"], d["text"]) for d in docs], 6, top=4)


def test_collocations_of_empty_and_long_texts(make):
    none = make([], "lang string, text string")
    assert collocations.collocations(none).count() == 0
    text = "New York, " * 50_000 + "x " * 3
    got = rows_of(collocations.collocations(make([{"lang": "en", "text": text}], "lang string, text string")), *COLUMNS)
    assert got == [("en", 1, "new york", 50_000, 50_000, 50_000, 100_003, 1_000_000)]


def test_scores_beyond_64_bits(spark):
    big = 2**62 + 1
    rows = [("x", "a", big, 1), ("x", "b", big - 2, 1), ("x", "a b", big - 3, 2)]
    got = collocations.weakest_cuts(spark.createDataFrame(rows, "lang string, phrase string, n bigint, n_words int")).collect()
    assert [(r.a, r.l, r.r, r.score) for r in got] == [(big - 3, big, big - 2, 2000000 * (big - 3) // (2 * big - 2))]


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_trie_bursts_and_spills_whole_subtrees(width):
    rnd = np.random.default_rng(2)
    trie, want = collocations.HatTrie(width, burst=8, held=100), collections.Counter()
    for _ in range(5):
        rows = rnd.integers(1, 300, (300, width)) % np.array([300, 4, 3, 2][:width])
        want.update(map(tuple, rows.tolist()))
        trie.add(*collocations.distinct_rows(rows))
    assert trie.total == len(want)
    assert width == 1 or any(isinstance(c, collocations.Node) for c in trie.root.values())
    got, gone = collections.Counter(), set()
    for keep in (len(want) // 2, 0):
        for rows, counts in trie.spill(keep):
            blocks = set((rows[:, 0] >> trie.block_bits).tolist())
            assert width == 1 or (len(blocks) == 1 and not blocks & gone)  # a subtree leaves whole, and once
            gone |= blocks
            got.update(dict(zip(map(tuple, rows.tolist()), counts.tolist())))
        assert trie.total <= keep
    assert got == want


# -- 13: alignment ---------------------------------------------------------------------------------------------------


def brute_alignment(docs):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(BYTES), SentencePieceProcessor(model_file=PIECES)
    a_model.encode_special_tokens = True
    alphabet = alignment.byte_level_alphabet()
    groups, pairs = [], collections.Counter()
    for _, text in docs:
        whole = (" " + (text or "")).encode()
        a = a_model.encode(whole.decode(), add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        raw_a = [bytes(alphabet[c] for c in a_model.id_to_token(i)) for i in a]
        raw_b = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            groups.append((0, 0, []))
            continue
        ends = [np.cumsum([len(x) for x in raw]).tolist() for raw in (raw_a, raw_b)]
        cut, i, j, own = sorted(set(ends[0]) & set(ends[1])), 0, 0, []
        for e in cut:
            p, q = ends[0].index(e) + 1, ends[1].index(e) + 1
            own.append((a[i:p], b[j:q]))
            i, j = p, q
        groups.append((len(a), len(b), own))
        pairs.update({(x, y) for g, h in own for x in g for y in h})
    best = collections.defaultdict(int)
    for (x, _), n in pairs.items():
        best[x] = max(best[x], n)
    out = []
    for (d, _), (n_a, n_b, own) in zip(docs, groups):
        links = [(x, y) for g, h in own for x in g for y in h]
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in own)
        out.append((d, n_a, n_b, len(own), len(links), sum(pairs[k] == best[k[0]] for k in links), sum(pairs[k] for k in links),
                    hashlib.sha256(text.encode()).hexdigest() if n_a else ""))
    return sorted(out, key=lambda t: tuple((x is not None, x) for x in t))


LINKS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows_of(queries.op13_alignment(spark, sf), *LINKS) == brute_alignment(docs)


@pytest.mark.parametrize("head", [alignment.HEAD, 30, 0])
def test_alignment_odd_rows(make, head):
    texts = [None, "", " ", "▁", "word ▁ word", "a" * 5_000, "the cat " * 5_000, *odd_texts(150, odd=[c for c in ODD if c != "▁"])]
    rows = [{"doc_id": None if k % 11 == 0 else k % 40, "text": t, "_row": 1, "n_a": 2} for k, t in enumerate(texts)] + [{"doc_id": 1, "text": "same"}] * 3
    docs = make(rows, "doc_id bigint, text string, _row int, n_a int").repartition(3)
    got = alignment.align(docs, BYTES, PIECES, head=head, keep_groups=True)
    assert rows_of(got, *LINKS) == brute_alignment([(r["doc_id"], r["text"]) for r in rows])
    for r in got.collect():
        assert r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else "")
        assert r.n_overlaps <= r.n_links and r.n_overlaps >= max(r.n_a, r.n_b)


def test_alignment_of_no_rows(make):
    assert alignment.align(make([], "doc_id bigint, text string"), BYTES, PIECES).count() == 0


def test_vocabularies_without_the_conditions_are_not_cut():
    assert units.byte_level_cuts(BYTES) and units.piece_cuts(PIECES)
    assert not units.byte_level_cuts(P.path("word_bpe_49k.json"))
    model = alignment.Aligner(BYTES, PIECES)
    model.cut = False
    data = np.frombuffer("two words here".encode(), np.uint8)
    found, cut = model.units(data, np.array([0, len(data)]))
    assert len(found) == 1 and cut.tolist() == [0, 1]
    whole = model.text[found[0]]
    model.clear(), model.table.clear()
    model.cut = True
    found, _ = model.units(data, np.array([0, len(data)]))
    assert len(found) == 3 and ";".join(model.text[u] for u in found) == whole


def test_counting_makes_neither_overlaps_nor_texts(monkeypatch):
    """Only scoring needs them; the pairs and their numbers of links are the same."""
    text = "Some words, and sömé more wörds: 123 ab12 \U0001f600x.\nA line  of words".encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])

    def pairs(with_text):
        model = alignment.Aligner(BYTES, PIECES)
        model.with_text = with_text
        _, pair, times = alignment._row_pairs(model, *model.units(data, offsets))
        return sorted(zip(model.pairs[pair].tolist(), times.tolist()))

    want = pairs(True)
    monkeypatch.setattr(alignment, "overlaps", None)
    assert pairs(False) == want


def test_images_take_small_slices(monkeypatch):
    """A task's arrays are those of a small slice of a batch, whatever the batch; its images are the same."""
    sizes, encode = [], addressable.Encoder.encode

    def noted(self, data, offsets):
        sizes.append(len(data))
        return encode(self, data, offsets)

    class Context:
        get = staticmethod(lambda: Context)
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(addressable.Encoder, "encode", noted)
    monkeypatch.setattr(addressable, "TaskContext", Context)
    texts = ["some words of a text " * 400] * 120
    batch = pa.record_batch([pa.array([str(k) for k in range(120)]), pa.array(texts)], names=["_name", "_text"])
    images = list(addressable._images(BYTES, 2, addressable.IMAGE_IDS)(iter([batch])))
    assert max(sizes) <= 1 << 18 and sum(sizes) == sum(map(len, texts))
    read = [addressable.Image(b.column(4)[0].as_py()) for b in images]
    plain = addressable.Encoder(BYTES).tokenizer.encode(texts[0], add_special_tokens=False).ids + [2]
    assert [i.document(k).tolist() for i in read for k in range(len(i.ends))] == [plain] * 120


def test_full_table_keeps_units_met_again(monkeypatch):
    """Units that come back are encoded once, however many others fill the table between; the ids stay right."""
    learned = []
    learn = addressable.Encoder._learn
    monkeypatch.setattr(addressable.Encoder, "_learn", lambda self, new: (learned.extend(new), learn(self, new)))
    model = addressable.Encoder(BYTES)
    model.table.most = 60
    for k in range(40):
        texts = ["common words come back", " ".join(f"x{k * 20 + j}y" for j in range(20))]
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        offsets = np.cumsum([0, *map(len, texts)])
        ids, cut = model.encode(data, offsets)
        for i, t in enumerate(texts):
            assert ids[cut[i] : cut[i + 1]].tolist() == model.tokenizer.encode(t, add_special_tokens=False).ids
        assert len(model.table.keys) == len(model.table.numbers) == len(model.table.again) == len(model.runs.counts) < 200
    assert learned.count(b" words") == learned.count(b" back") == 1
