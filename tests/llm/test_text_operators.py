import base64
import bz2
import gzip
import random
import time
import tarfile
import lzma
import io
import urllib.parse
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from lacuna.llm import fingerprints, mixing, packing, pages, queries, rules, secret_scan
from lacuna.llm import text as text_views
from tests.llm import brute

ODD = [None, "", "   ", "\n\n", "one", "a\n\na\nb a", "x " * 30, "é" * 50, "w " * 5000, "A b\tc\x0bd\x0ce\rf"]


def words_text(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgé#") for _ in range(rng.randrange(1, 8))) + rng.choice(["", "", "\n", ". "]) for _ in range(n))


# --- fingerprints


def fingerprint_rows(df):
    return {r["doc_id"]: r for r in fingerprints.compare_with_next(df).collect()}


def test_fingerprints_follow_definitions(make, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_PER_RANGE", 5)
    texts = [words_text(k, 40 + k) for k in range(40)] + ODD
    ids = [k * k * 1000 - 7 for k in range(len(texts))]
    rows = {r["doc_id"]: r for r in fingerprints.compare_with_next(make([{"doc_id": d, "text": t} for d, t in zip(ids, texts)])).collect()}
    import hashlib

    order = sorted(range(len(ids)), key=lambda k: -ids[k])
    for place, k in enumerate(order):
        t, nxt = texts[k] or "", texts[order[(place + 1) % len(order)]] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = rows[ids[k]]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (t == edited)
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert len({r["fingerprint"] for r in rows.values()}) == len({t or "" for t in texts})


def test_fingerprint_differences(make):
    a = "one two\nthree\n\nfour\nfive"
    df = make([{"doc_id": 1, "text": a}]).select(
        fingerprints.differences(F.col("text"), F.lit(a)).alias("same"), fingerprints.differences(F.col("text"), F.lit("one two\nthree\n\nfour\nFIVE\nsix")).alias("edit")
    )
    r = df.first()
    assert r["same"] == [] and [tuple(x) for x in r["edit"]] == [(1, 1), (1, 2)]


def test_fingerprint_odd_tables(make):
    assert fingerprints.compare_with_next(make([])).count() == 0
    one = fingerprints.compare_with_next(make([{"doc_id": 5, "text": "a b"}])).first()
    assert one["near_next"] == 1.0 and one["near_edited"] < 1
    rows = fingerprints.compare_with_next(make([{"doc_id": 1, "text": "a"}, {"doc_id": 1, "text": "a"}, {"doc_id": None, "text": "b"}, {"doc_id": None}])).collect()
    assert len(rows) == 4


# --- packing


def test_packing_ids_places_and_number(make, sf, spark):
    from tokenizers import Tokenizer

    texts = ODD + [words_text(k, 300) for k in range(30)] + ["Don't  stop!'s <|endoftext|> x <|startoftext|>y", "Ǆ ΑΣ ﬁ́    İ"]
    df = packing.pack(packing.token_pieces(make([{"doc_id": k, "text": t} for k, t in enumerate(texts)]), queries.tokenizer_file(), capacity=256), capacity=256)
    rows = df.collect()
    tok = Tokenizer.from_file(queries.tokenizer_file())
    want, total = {}, 0
    for k, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        total += len(ids)
        for p, s in enumerate(range(0, len(ids), 256)):
            want[k, p] = (s, len(ids[s : s + 256]), zlib.crc32(np.array(ids[s : s + 256], dtype="<u4").tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    check_places(rows, 256)
    assert len({r["sequence_id"] for r in rows}) <= -(-total // 256) + 1


def check_places(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= capacity


@pytest.mark.parametrize("seed", range(4))
def test_sweep_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    sizes = [rng.randrange(1, 65) for _ in range(400)]
    counts = {n: sizes.count(n) for n in set(sizes)}
    used = {}
    for length, a, b, seq, off, per in packing.sweep(counts, 64):
        for r in range(a, b):
            used.setdefault(seq + (r - a) // per, []).append((off + (r - a) % per * length, length))
    assert sorted(n for v in used.values() for _, n in v) == sorted(sizes)
    for v in used.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 64
    bins = []
    for n in sorted(sizes, reverse=True):
        fit = [k for k, g in enumerate(bins) if g >= n]
        if fit:
            bins[min(fit, key=lambda k: bins[k])] -= n
        else:
            bins.append(64 - n)
    assert len(used) == len(bins)


def test_packing_odd_tables(make, spark):
    assert packing.pack(packing.token_pieces(make([]), queries.tokenizer_file())).count() == 0
    df = spark.createDataFrame([(1, 3, "s"), (1, 3, "s"), (2, 0, "s"), (3, None, "s")], "doc_id int, length int, sequence_id string")
    rows = packing.pack(df, capacity=4)
    assert rows.columns == ["doc_id", "length", "sequence_id", "sequence_id_", "offset"]
    got = {(r["doc_id"], r["sequence_id_"], r["offset"]) for r in rows.collect()}
    assert {g[1] for g in got if g[0] == 1} == {0, 1} and (2, None, None) in got and (3, None, None) in got
    with pytest.raises(ValueError):
        packing.pack(df, capacity=2)


# --- pages


def test_page_lines_and_differencing(spark):
    site = '<nav><a href="/">Home</a></nav><div class="ad top">Buy</div>'
    pages_ = [
        (1, "http://h.example/a/1", f"<html><head><title>T</title></head><body>{site}<div>Shared&nbsp;bar</div><article><h1>One</h1><p>Text &amp; more<br>next<p>last</article><div id=comments><p>no</p></div></body>"),
        (2, "http://h.example/a/2", f"<body>{site}<p>Shared bar</p><p>Own text</p><form><p>f</p></form><p>Foot line</p>"),
        (3, "http://h.example/a/3", f"<body>{site}<p>Shared bar</p><p>Other text</p><p>Foot line</p><p cl"),
        (4, "http://else.example/a/3", "<p>Own text</p><p>Foot line</p>"),
        (5, None, None), (6, "", ""), (7, "x", "<nav>open menu<article>kept</article>"), (8, "y", "a<!-- c --><script>if (a<b) {}</script>b"),
    ]
    df = spark.createDataFrame(pages_, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in pages.main_text(df).collect()}
    assert got == {1: "One\nText & more\nnext\nlast", 2: "Own text\nFoot line", 3: "Other text", 4: "Own text\nFoot line", 5: "", 6: "", 7: "kept", 8: "a b"}
    assert pages.main_text(df.limit(0)).count() == 0
    twice = pages.main_text(df.where("page_id = 4").unionAll(df.where("page_id = 4"))).collect()
    assert [r["text"] for r in twice] == ["Own text\nFoot line"] * 2  # a copy is nobody's nearest page


def test_names_take_out_no_article_text():
    """Words inside a class or id say nothing; in an article a named block goes only where its text is links."""
    page = (
        '<body><div class="top ad">Buy</div><article class="post has-sidebar"><h2 id="how-to-share-files">How</h2><h3 class="notice">Head</h3>'
        '<section id="social-history"><p>History</p></section><p class="notice-period">Period</p><div class="notice">Mind this</div>'
        '<div class="share"><a href="/x">Send</a> <a href="/y">Post</a></div><p>End</p></article><div role="search">Find</div></body>'
    )
    assert pages.lines(page) == (["How", "Head", "History", "Period", "Mind this", "End"], [True] * 6, True)


def test_common_subsequence():
    rng = random.Random(3)
    for _ in range(500):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(9))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        c = pages.common(a, b)
        rest = iter(b)
        assert len(c) == t[-1][-1] and c == sorted(set(c)) and all(any(x == y for y in rest) for x in [a[k] for k in c])


# --- quality rules


def test_rule_counts_equal_brute_force(make, spark):
    texts = ODD + [words_text(k, 60) for k in range(20)] + [words_text(9, 12) * 3, "l1 a\nl1 a\n \nl1 a"]
    docs = make([{"doc_id": k, "text": t} for k, t in enumerate(texts)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(5, 20)] + [(5, 0), (None, 1), (999, 1)], "doc_id bigint, quality int")
    rows, at = rules.quality_rules(docs, labels, trees=10, sample=16)
    for r in rows.collect():
        want = brute.counts(texts[r["doc_id"]])
        assert {k: r[at][k] for k in want} == want
        assert not (want["base_failed"] and r[at]["kept"])
    empty, at = rules.quality_rules(make([]), labels)
    assert empty.count() == 0
    bare, at = rules.quality_rules(docs, labels.limit(0))
    assert all(r[at]["kept"] != r[at]["base_failed"] for r in bare.collect())


def test_forest_sets_outliers_apart():
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(0, 1, (500, 4)), rng.normal(9, 1, (5, 4))]
    s = rules.grow_forest(x, 50, 128).scores(x)
    assert s[-5:].min() > np.quantile(s[:500], 0.99)


# --- secrets


def test_base_secrets_equal_brute_force():
    rng = random.Random(4)
    bits = ["token", "Token = ", "api_key:", "APIKEY='", "password:token =", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "passwd", "=", ": ", '"', "x" * 7, " ", "\n", "é"]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        assert secret_scan.scan(t)[0] == brute.base_spans(t)


def test_layers_are_unwrapped_and_mapped():
    s = 'token = "abcdef123"'
    b = base64.b64encode(s.encode()).decode()
    for layer in (b, base64.b64encode(b.encode()).decode(), base64.b64encode(gzip.compress(s.encode())).decode(),
                  base64.b64encode(bz2.compress(b.encode())).decode(), base64.urlsafe_b64encode(zlib.compress(s.encode())).decode().rstrip("=")):
        text = f"héad {layer} tail"
        base, spans, over = secret_scan.scan(text)
        assert base == [] and over == 0 and len(spans) == 1
        a, kind, e = spans[0]
        assert kind == 0 and text[a:e].strip("=") in layer and 5 <= a < e <= 5 + len(layer)
    url = urllib.parse.quote(urllib.parse.quote(s))
    assert [u[1] for u in secret_scan.scan("x " + url)[1]] == [0]
    esc = "".join(f"\\u{ord(c):04x}" for c in s)
    assert secret_scan.scan(esc)[1] == [(0, 0, len(esc) - 6)]
    bomb = base64.b64encode(gzip.compress(b"0" * 10_000)).decode()
    assert secret_scan.scan(bomb, limit=1000)[2] == 1
    assert secret_scan.scan("%25" * 50 + "\\x5cx41" * 3)[0] == []


def test_secrets_on_tables(make):
    rows, at = secret_scan.scan_secrets(make([{"doc_id": 1, "text": "AKIA" + "Z" * 16}, {"doc_id": 2}, {"doc_id": 3, "text": ""}]))
    got = {r["doc_id"]: r[at] for r in rows.collect()}
    assert got[1]["spans"] == "access:0:20" and got[2]["spans"] == "" and got[3]["n_access"] == 0
    masked = make([{"doc_id": 1, "text": "a token=abcdef1 AKIA" + "Z" * 16}, {"doc_id": 2}]).select(secret_scan.masked(F.col("text")).alias("t"))
    assert [r["t"] for r in masked.collect()] == ["a [SECRET] [SECRET]", None]
    assert secret_scan.scan_secrets(make([]))[0].count() == 0


# --- mixing


def targets_by_hand(sizes, share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        rate = left / sum(w[s] for s in open_)
        over = [s for s in open_ if rate * w[s] > most * sizes[s]]
        if not over:
            out |= {s: rate * w[s] for s in open_}
            break
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
            open_.discard(s)
    return out


def test_mix_targets_and_taken(make):
    rng = random.Random(2)
    sources = [None, "", "b", "ä", "Z", "a", "hot"]
    docs = [{"doc_id": k, "source": rng.choice(sources + ["hot"] * 8), "text": "w " * rng.randrange(0, 40)} for k in range(600)]
    docs += [{"doc_id": 1, "source": "b", "text": "x y"}] * 2 + [{"doc_id": None, "source": "b", "text": "x"}, {"doc_id": 9000, "source": "void"}]
    rows, at = mixing.mix_sources(make(docs))
    got = rows.collect()
    sizes = {}
    for d in docs:
        sizes[d["source"]] = sizes.get(d["source"], 0) + len(brute.WORD.findall(d.get("text") or ""))
    want = targets_by_hand(sizes)
    taken, biggest = {}, {}
    for r in got:
        m = r[at]
        assert m["source_size"] == sizes[r["source"]] and m["target"] == pytest.approx(want[r["source"]], rel=1e-9)
        assert m["taken"] in (0, m["size"], 2 * m["size"])
        taken[r["source"]] = taken.get(r["source"], 0) + m["taken"]
        biggest[r["source"]] = max(biggest.get(r["source"], 0), m["size"])
    for s, n in taken.items():
        assert abs(n - want[s]) <= biggest[s] + 2
    assert sorted(map(str, rows.collect())) == sorted(map(str, got))
    mixed = mixing.mixed_documents(make(docs))
    assert mixed.columns == make(docs).columns
    assert sum(len(brute.WORD.findall(r["text"] or "")) for r in mixed.collect()) == sum(taken.values())


def test_mix_odd_tables(make):
    assert mixing.mix_sources(make([]))[0].count() == 0
    extra = "doc_id bigint, text string, source string, mix string, target int, h int, size int"
    rows, at = mixing.mix_sources(make([{"doc_id": 1, "text": "a", "source": "s", "size": 7}], extra))
    assert at == "mix_" and rows.first()["size"] == 7 and rows.first()[at]["size"] == 1


@pytest.mark.parametrize("kind", ["path", "prefix", "tail", "wrapped", "packed path", "packed lines", "members"])
def test_base64_is_found_wherever_it_begins(kind):
    """Base64 after a path or prefix, before other text, over several lines, and of several compressed members."""
    rng = random.Random(5)
    secret = b"key AKIA" + b"ABCDEFGHIJKLMNOPQRST" + b" end"
    filler = bytes(rng.randrange(97, 123) for _ in range(400))
    lines = lambda b: base64.encodebytes(b).decode()
    text = {
        "path": "see https://h.example/x/" + base64.b64encode(secret).decode() + " now",
        "prefix": "key-" + base64.b64encode(secret).decode(),
        "tail": base64.urlsafe_b64encode(secret).decode().rstrip("=") + "_-text",
        "wrapped": "x:\n" + lines(filler[:35] + secret + filler) + "\nafter",
        "packed path": "https://h.example/x/" + base64.b64encode(gzip.compress(secret)).decode(),
        "packed lines": lines(gzip.compress(filler + secret)),
        "members": base64.b64encode(gzip.compress(filler) + gzip.compress(secret)).decode(),
    }[kind]
    spans = [s for s in secret_scan.scan(text)[1] if s[1] == 1]
    assert spans and all(0 <= a < b <= len(text) for a, _, b in spans)


SECRET = b"key AKIA" + b"ABCDEFGHIJKLMNOPQRST" + b" end"


def test_secrets_among_binary_bytes():
    """An archive's members, binary bytes before a secret, a false magic number, streams within streams, a quine's cycle."""
    rng = random.Random(6)
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w:gz") as z:
        for name, data in (("a", rng.randbytes(5000)), ("b", SECRET), ("c", b"\x78\x9c\x01" + rng.randbytes(3000))):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            z.addfile(info, io.BytesIO(data))
    packed = (gzip.compress, bz2.compress, lzma.compress, zlib.compress, zstandard.compress)
    for raw in (buf.getvalue(), gzip.compress(rng.randbytes(999) + SECRET), rng.randbytes(70) + gzip.compress(SECRET),
                *(f(b"\xff\x78\x9c\x63" + rng.randbytes(50) + g(b"\x00\x01" * 40 + SECRET) + b"\xfe") for f in packed for g in packed)):
        text = "é " + base64.b64encode(raw).decode() + " tail"
        spans, over = secret_scan.scan(text)[1:]
        assert [s[1] for s in spans].count(1) >= 1 and over == 0
        assert all(2 <= a < b <= len(text) - 5 for a, _, b in spans)


@pytest.mark.parametrize("seed", range(40))
def test_random_nestings_keep_the_secret(seed):
    rng = random.Random(seed)
    raw = SECRET
    steps = [lambda b: base64.b64encode(b), lambda b: base64.encodebytes(b), lambda b: gzip.compress(b), lambda b: lzma.compress(b),
             lambda b: urllib.parse.quote_from_bytes(b, safe="").encode(), lambda b: rng.randbytes(20) + zlib.compress(b) + rng.randbytes(9),
             lambda b: "".join(f"\\x{c:02x}" for c in b).encode() if b.isascii() else base64.b64encode(b)]
    for _ in range(rng.randrange(1, 5)):
        raw = rng.choice(steps)(raw)
    text = "t: " + base64.b64encode(raw).decode() + " end"
    found = secret_scan.scan(text)
    assert any(k == 1 for _, k, _ in found[1]) and found[0] == [] and found[2] == 0


def test_long_layers_end_in_linear_time():
    rng = random.Random(7)
    start = time.monotonic()
    text = "x " + base64.b64encode(rng.randbytes(3_750_000)).decode() + " AKIA" + "B" * 16
    base, spans, over = secret_scan.scan(text)
    assert set(base) <= set(spans) and over == 0 and any(s[1] == 1 for s in base)
    big = gzip.compress(b"\x00" * 100_000_000 + SECRET, 1)
    assert [s[1] for s in secret_scan.scan("x " + base64.b64encode(big).decode())[1]] == [1]
    assert time.monotonic() - start < 60


def test_secrets_keep_clashing_columns(make):
    rows, at = secret_scan.scan_secrets(make([{"doc_id": 1, "text": "AKIA" + "Z" * 16}] * 2).withColumn("secrets", F.lit("own")))
    assert at != "secrets" and [(r["secrets"], r[at]["n_access"]) for r in rows.collect()] == [("own", 1)] * 2


@pytest.mark.parametrize("html,text", [
    ('<div role="main"><p>Real</p></div><p>Side</p>', "Real"),
    ('<main><article><p>Story</p></article><section class="comments"><p>me too</p></section></main>', "Story"),
    ('<article><p>Story</p><div class="ad">Buy now</div><p>End</p></article>', "Story\nEnd"),
    ('<article data-title="a hidden gem"><p title="the hidden cost">Kept</p><p hidden>gone</p><p style="display: none">gone</p></article>', "Kept"),
    ('<div class="cookie-notice">We use cookies</div><p>A long enough text of the page</p><div class="post-comments">First!</div>', "A long enough text of the page"),
    ("<head><title>T</title><meta name=a><p>Text</p>", "Text"),
    ('<article><p>Story of the day</p></article><div class="related"><article><a href="/x">Card</a></article></div>', "Story of the day"),
    ('<aside><article><p>Card</p></article></aside><div><p>Story</p></div>', "Story"),
    ('<form id="f"><main><p>Wrapped</p></main></form>', "Wrapped"),
    ('<div class="has-sidebar"><p>Text</p></div><div class="left-sidebar">x</div>', "Text"),
    ('<p>a <img alt="x > y"> b</p><p title="open>c</p>', "a b\nc"),
    ("<ul><li class=ad>Buy<li>Real item here</ul>", "Real item here"),
    ("<p>cut <a href", "cut"),
])
def test_page_shapes(html, text):
    out, kinds = pages.blocks(html)
    assert "\n".join(r for r, k in zip(out, kinds) if k != pages.OUTSIDE) == text


def test_every_page_is_differenced(spark):
    """Copies are passed over; in an article a named block goes where the nearest other page shares it."""
    body = '<article><p>{}</p><p>Shared quote</p><div class="notice"><p>Read our terms</p></div></article>'
    df = spark.createDataFrame([
        (1, "http://h.example/b", body.format("One")), (2, "http://h.example/b?print=1", body.format("One")),
        (3, "http://h.example/c", body.format("Two")), (4, "http://solo.example/", body.format("Three")),
        (5, "http://o.example/x", "<p>Own</p><p>Bar</p>"), (6, "http://o.example/x?print=1", "<p>Own</p><p>Bar</p>"), (7, "http://o.example/y", "<p>Else</p><p>Bar</p>"),
    ], "page_id int, url string, html string").withColumns({"same": F.lit(1), "host": F.lit("h")})
    got = {r["page_id"]: r["text"] for r in pages.main_text(df).collect()}
    assert got == {1: "One\nShared quote", 2: "One\nShared quote", 3: "Two\nShared quote", 4: "Three\nShared quote\nRead our terms",
                   5: "Own", 6: "Own", 7: "Else"}


@pytest.mark.parametrize("html", [
    "<div class='widget'>x" * 50_000, '<a b="' * 150_000, "<a b='\"" * 150_000, "<p class='ad'>" * 70_000, "<!" * 300_000, "<b>" * 100_000 + "</i>" * 100_000,
    "<article><div class=share><a href=x>y</a>" * 20_000, "a" * 1_000_000,
])
def test_long_pages_end_in_linear_time(html):
    start = time.monotonic()
    pages.blocks(html)
    assert time.monotonic() - start < 20


def test_halved_alignment_is_as_long(monkeypatch):
    rng = random.Random(8)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(30))] for _ in range(2))
        monkeypatch.setattr(pages, "ROW_BITS", 1 << 28)
        want = len(pages.common(a, b))
        monkeypatch.setattr(pages, "ROW_BITS", 8)
        c = pages.common(a, b)
        rest = iter(b)
        assert len(c) == want and c == sorted(set(c)) and all(any(x == y for y in rest) for x in [a[k] for k in c])


def test_packing_ranks_by_content(spark):
    """One length for all pieces, rows of one id: places are gapless and the same in each run, sent plan or joined plan."""
    df = spark.range(3000).select((F.col("id") % 3).alias("doc_id"), F.lit(7).alias("length"), F.col("id").alias("nth"), F.create_map(F.lit("a"), "id").alias("m"))
    runs = []
    for rows in (packing.PLAN_ROWS, 0, 0):
        packing.PLAN_ROWS, was = rows, packing.PLAN_ROWS
        try:
            got = packing.pack(df.repartition(3, "nth"), capacity=15).collect()
        finally:
            packing.PLAN_ROWS = was
        runs.append(sorted((r["nth"], r["sequence_id"], r["offset"]) for r in got))
    assert runs[0] == runs[1] == runs[2]
    assert sorted((s, o) for _, s, o in runs[0]) == [(k // 2, 7 * (k % 2)) for k in range(3000)]


def test_workers_keep_little_memory():
    """Rules work on small slices of a batch, and powers made for one long text go with it."""
    sizes = []
    batch = pa.record_batch([pa.array(["word " * 1000] * 700)], names=["t"])
    for _, data, _ in text_views.slices(batch, "t"):
        sizes.append(len(data))
    assert max(sizes) <= 1 << 20 and sum(sizes) == 5000 * 700
    long = pa.record_batch([pa.array(["word " * 500_000])], names=["t"])
    for _, data, offsets in text_views.slices(long, "t"):
        rules.text_counts(data, offsets)
    assert all(len(p) <= text_views.KEPT_POWERS for p in text_views._powers.values())


def test_rules_take_small_slices(monkeypatch):
    """A worker's arrays are those of a small slice of a batch, whatever the batch; verdicts come for all rows."""
    sizes, counts = [], rules.text_counts
    monkeypatch.setattr(rules, "text_counts", lambda data, offsets: (sizes.append(len(data)), counts(data, offsets))[1])
    texts = pa.array([None, *(f"word{k} some other words, one after another " * 300 for k in range(150)), ""])
    got = rules._judge(None)(texts)
    assert max(sizes) <= 1 << 18 and sum(sizes) == sum(len(t) for t in texts.to_pylist() if t)
    assert len(got) == 152 and [r["n_words"] for r in got.to_pylist()] == [0, *[2100] * 150, 0]
    assert len(rules._judge(None)(texts.slice(0, 0))) == 0
