"""Secret scanning with a recursive decoding worklist.

A text is scanned as it stands, then every layer hidden in it: percent-encoding, Unicode escapes, base64 runs and
compressed bytes within them.  Each decoded layer joins the worklist and is scanned and unwrapped in its turn until
nothing new appears; a layer whose content and place were seen before is not entered again.  Every layer carries, for
each character, the span of the original text it came from, so whatever is found is reported in code points of the
original.

A base64 run is decoded as a whole and, where that is no text, at all four alignments: every readable stretch of at
least ``MIN_READABLE`` bytes and every compressed stream in it is a layer, so a path or prefix before the base64, or text
after it, hides nothing.  Runs on neighbouring lines are also decoded as one.  Compressed members that follow each other
are unpacked one by one.

In-place layers (percent, Unicode escapes) decode the whole text around them, so a key name and its encoded value still
meet; of their finds only those that touch a decoded character are new.  The work of a document depends on that document
alone.

Compressed streams are unpacked piece by piece, however much they hold: readable stretches of at least ``MIN_READABLE``
bytes are scanned and streams within them (an archive's members) unpacked in their turn, so bytes that are no text hide
nothing.  All that a stream holds has the stream's span.  A stream that unpacks to itself is left after its third
round.  With an opt-in ``limit``, a stream that unpacks to more bytes counts in ``n_unscanned``, as do streams nested
more than ``MAX_DEPTH`` deep, so no limit is silent.

Time and memory of a long text grow in proportion to its length.  ``password`` and its like match letters in either case
as Unicode folds them, so U+017F stands for an s and U+212A for a k there.  Defined results: null is the empty text
without finds; equal texts have equal results, repeated rows each their own; an empty table gives an empty result; other
columns pass through, and the struct is named anew where a column is called ``secrets``.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from array import array
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import fresh
from .session import ship
from .text import give_back

# fixed values of the base patterns
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24

MIN_BASE64 = 16
CHUNK = 1 << 20  # bytes of an unpacked stream that are held at once, beside a run that is not over yet
MAX_DEPTH = 100  # streams within streams; deeper ones are counted in `n_unscanned`

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
# a whole value with percent codes: bytes that need no code stand between them
_VALUE = re.compile(r"(?<![\w.~!*'()+/&=$,;:@?#-])[\w.~!*'()+/&=$,;:@?#-]*+(?:%[0-9A-Fa-f]{2}[\w.~!*'()+/&=$,;:@?#-]*+)++", re.A)
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,6}\})+")
_ONE_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_BASE64)
# begins where a run begins and never gives back, so each character is read once
_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}+(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}" % MIN_BASE64)
MIN_READABLE = 12  # no pattern matches fewer characters
_STRETCH = re.compile(
    rb"(?:[\t\n\r\x20-\x7e]++|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})++"
)
_MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
_LONGEST_MAGIC = 6
_DASHES = str.maketrans("-_", "+/")
# no match, code or run holds one of these bytes, so a text may be cut there
_CUTS = bytes(chr(c) not in "%\\{}\"' :\t\r\n+/_.=-" and not (c < 128 and chr(c).isalnum()) for c in range(256))

Span = tuple[int, int, int]  # start, kind's place in KINDS, end


def find(text: str) -> list[Span]:
    """The base patterns' matches, leftmost and non-overlapping for each kind, failing ones dropped."""
    out: list[Span] = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    # a maximal run of hex digits is one match, so asking for the least length at once finds the same runs
    out += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return out


class Layer:
    """A text with, for each character, its span in the original and whether it was decoded.

    What was unpacked has one span for all its characters (``one``), and all of them are decoded.
    """

    __slots__ = ("text", "start", "end", "made", "one")

    def __init__(self, text: str, start, end, made: bytearray | None, one: tuple[int, int] | None = None):
        self.text, self.start, self.end, self.made, self.one = text, start, end, made, one

    def span(self, a: int, b: int) -> tuple[int, int]:
        """Where the characters from ``a`` to ``b`` (exclusive) came from."""
        return self.one or (self.start[a], self.end[b - 1])

    def places(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for many at once, the last character included."""
        if self.one:
            return np.full(len(first), self.one[0]), np.full(len(last), self.one[1])
        return _take(self.start, first), _take(self.end, last)


def _whole(text: str) -> Layer:
    n = len(text)
    return Layer(text, range(n), range(1, n + 1), bytearray(n))


def _take(places, at: np.ndarray) -> np.ndarray:
    return at + places.start if isinstance(places, range) else np.frombuffer(places, dtype=np.int64)[at]


def _held(places: np.ndarray) -> array:
    out = array("q")
    out.frombytes(places.astype(np.int64).tobytes())
    return out


class _Zstd:
    """Unpacks all that it is given, at most 128 KiB for every four bytes, so it is given a little at a time."""

    def __init__(self) -> None:
        import zstandard

        self.d, self.eof, self.unused_data = zstandard.ZstdDecompressor(max_window_size=1 << 27).decompressobj(), False, b""

    def pieces(self, data: bytes) -> Iterator[bytes]:
        for k in range(0, len(data), 1024):
            yield self.d.decompress(data[k : k + 1024])
            if self.d.eof:
                self.eof, self.unused_data = True, self.d.unused_data + data[k + 1024 :]
                return


def _member(raw: bytes):
    """A decompressor for the stream that begins here (None: not one)."""
    if raw[:2] == b"\x1f\x8b" or (raw[:1] == b"\x78" and len(raw) > 2 and (raw[0] * 256 + raw[1]) % 31 == 0):
        return zlib.decompressobj(47)
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if raw[:4] == b"\x28\xb5\x2f\xfd":
        return _Zstd()
    return lzma.LZMADecompressor(memlimit=1 << 28) if raw[:6] == b"\xfd7zXZ\x00" else None


_ZLIB = type(zlib.decompressobj())


def _pieces(d, data: bytes) -> Iterator[bytes]:
    """What ``d`` makes of ``data``, a bounded piece at a time."""
    if isinstance(d, _ZLIB):
        full = False
        while (data or full) and not d.eof:
            out = d.decompress(data, CHUNK)
            data, full = d.unconsumed_tail, len(out) == CHUNK
            yield out
    elif isinstance(d, bz2.BZ2Decompressor | lzma.LZMADecompressor):
        yield d.decompress(data, CHUNK)
        while not d.eof and not d.needs_input:
            yield d.decompress(b"", CHUNK)
    else:
        yield from d.pieces(data)


class _Stream:
    """A compressed stream with all its members, unpacked into ``into`` as its bytes come in."""

    def __init__(self, into: "_Hidden"):
        self.into, self.d, self.early, self.left, self.size = into, None, b"", -1, 0
        self.over = self.broken = self.weak = False

    def feed(self, data: bytes) -> None:
        """Takes the next bytes; ``left`` is set to how many of them lie beyond the stream's end once it is over."""
        data, self.early = self.early + data, b""
        self.weak = self.weak or (self.size == 0 and data[:1] == b"\x78")  # two bytes alone say that it is one
        try:
            while data:
                if self.d is None:
                    data = data.lstrip(b"\0") if self.size else data
                    if len(data) < _LONGEST_MAGIC:
                        self.early = data
                        return
                    self.d = _member(data)
                    if self.d is None:
                        self.left = len(data)
                        return
                for out in _pieces(self.d, data):
                    self.size += len(out)
                    if self.into.scan.limit is not None and self.size > self.into.scan.limit:
                        self.over, self.left = True, 0
                        return
                    self.into.feed(out)
                if not self.d.eof:
                    return
                data, self.d = self.d.unused_data, None
        except (zlib.error, OSError, ValueError, EOFError, lzma.LZMAError):
            self.left, self.broken = 0, True  # what came before the broken member counts
        except Exception as e:  # the zstd library's own error type
            if type(e).__name__ != "ZstdError":
                raise
            self.left, self.broken = 0, True

    def covers(self) -> bool:
        """Whether the bytes up to its end are surely the stream's, so that none begins inside it."""
        return self.size > 0 and not self.broken and (self.left >= 0 or not self.weak)

    def close(self) -> None:
        if self.over:
            self.into.scan.unscanned += 1
        elif self.size:
            self.into.close()


class _Hidden:
    """Unpacked bytes of one span, taken piece by piece: their readable stretches are scanned, streams in them unpacked.

    Text is handed on up to the last byte that no pattern can hold; a run that is not over yet is kept.  A stream in
    these bytes covers them up to its end, so magic numbers inside it are not tried, unless it breaks off.
    """

    def __init__(self, scan: "_Scan", one: tuple[int, int], heads: tuple[bytes, ...]):
        self.scan, self.one, self.heads = scan, one, heads
        self.come: list[bytes] = []
        self.size = 0
        self.run: list[bytes] = []
        self.tail = b""
        self.inner: _Stream | None = None
        self.behind: bytes | None = None  # what followed the start of `inner`, should it prove to be none
        self.dead = self.begun = False

    def feed(self, data: bytes) -> None:
        if data and not self.dead:
            self.come.append(data)
            self.size += len(data)
            if self.size >= CHUNK:
                self._take(b"".join(self.come))
                self.come, self.size = [], 0

    def close(self) -> None:
        if not self.dead:
            self._take(b"".join(self.come))
            self._text(b"".join(self.run))
            while self.inner is not None:
                inner, behind, self.inner, self.behind, self.tail = self.inner, self.behind, None, None, b""
                inner.close()
                if behind and not inner.covers():
                    self._streams(behind)

    def _take(self, data: bytes) -> None:
        if not self.begun:  # a stream that unpacks to itself ends here
            self.begun = True
            head = hashlib.sha256(data).digest()
            if self.heads.count(head) > 1:
                self.dead = True
                return
            self.heads += (head,)
            if len(self.heads) > MAX_DEPTH:
                self.dead = True
                self.scan.unscanned += 1
                return
        cut = data.translate(_CUTS).rfind(1) + 1
        if cut:
            self._text(b"".join([*self.run, data[:cut]]))
            self.run = []
        self.run.append(data[cut:])
        self._streams(data)

    def _text(self, raw: bytes) -> None:
        for m in _STRETCH.finditer(raw):
            if m.end() - m.start() >= MIN_READABLE:
                self.scan.all_of(Layer(m.group().decode("utf-8"), None, None, None, self.one))

    def _streams(self, data: bytes) -> None:
        done, old = 0, len(self.tail)
        if self.inner is not None:
            inner = self.inner
            inner.feed(data)
            if inner.left < 0:
                self.behind = None if self.behind is None or not inner.weak else self.behind + data
                if self.behind is not None and len(self.behind) > 4 * CHUNK:
                    self.behind = None
                return
            if inner.covers():
                done = len(data) - inner.left
            elif self.behind:
                data = self.behind + data
            inner.close()
            self.inner = self.behind = None
            old = 0
        else:
            data = self.tail + data
        for m in _MAGIC.finditer(data):
            if m.start() < done or m.end() <= old:
                continue
            inner = _Stream(_Hidden(self.scan, self.one, self.heads))
            inner.feed(data[m.start() :])
            if inner.left < 0:
                self.inner, self.tail, self.behind = inner, b"", data[m.start() + 1 :]
                return
            if inner.covers():
                done = len(data) - inner.left
            inner.close()
        self.tail = data[max(done, len(data) - _LONGEST_MAGIC + 1) :]


def _readable(raw: bytes) -> str | None:
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    odd = 0 if text.isprintable() else sum(1 for c in text if not (c.isprintable() or c in "\t\n\r"))
    return text if text and odd * 10 <= len(text) else None


def _mapped(text: str, raw: bytes, start: np.ndarray, end: np.ndarray) -> Layer:
    """``text`` decoded from ``raw``, whose bytes came from the places ``start`` to ``end``."""
    first = np.flatnonzero((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)
    return Layer(text, _held(start[first]), _held(end[np.r_[first[1:], len(raw)] - 1]), bytearray(b"\x01") * len(text))


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> tuple[Layer | None, bool]:
    """The layer with each match of ``pattern`` decoded in place, and whether a match holds bytes which are not text."""
    parts, start, end, made, at, raw = [], array("q"), array("q"), bytearray(), 0, False
    mapped, changed = layer.one is None, False
    for m in pattern.finditer(layer.text):
        got = decode(m)
        if got is None:
            raw = True
            continue
        parts.append(layer.text[at : m.start()])
        parts += [c for c, _, _ in got]
        if mapped:
            start.extend(layer.start[at : m.start()])
            end.extend(layer.end[at : m.start()])
            made += layer.made[at : m.start()] + b"\x01" * len(got)
            start.extend(layer.start[a] for _, a, _ in got)
            end.extend(layer.end[b - 1] for _, _, b in got)
        at, changed = m.end(), True
    if not changed:
        return None, raw
    parts.append(layer.text[at:])
    if not mapped:
        return Layer("".join(parts), None, None, None, layer.one), raw
    start.extend(layer.start[at:])
    end.extend(layer.end[at:])
    made += layer.made[at:]
    return Layer("".join(parts), start, end, made), raw


def _percent(m: re.Match):
    raw = bytes.fromhex(m.group().replace("%", ""))
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    out, at = [], m.start()
    for c in text:
        size = 3 * len(c.encode("utf-8"))
        out.append((c, at, at + size))
        at += size
    return out


def _escapes(m: re.Match):
    units = [(int(next(filter(None, x.groups())), 16), m.start() + x.start(), m.start() + x.end()) for x in _ONE_ESCAPE.finditer(m.group())]
    out, k = [], 0
    while k < len(units):
        code, a, b = units[k]
        k += 1
        if 0xD800 <= code < 0xDC00 and k < len(units) and 0xDC00 <= units[k][0] < 0xE000:
            code, b, k = 0x10000 + ((code - 0xD800) << 10) + units[k][0] - 0xDC00, units[k][2], k + 1
        out.append(("\ufffd" if 0xD800 <= code < 0xE000 or code > 0x10FFFF else chr(code), a, b))
    return out


def _bytes(body: str) -> bytes | None:
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body.translate(_DASHES) + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


class _Scan:
    """The worklist of one text: all spans found, and the number of streams that were left unscanned."""

    def __init__(self, limit: int | None):
        self.limit, self.unscanned = limit, 0
        self.found: set[Span] = set()
        self.seen: set[tuple[bytes, int, int]] = set()

    def all_of(self, first: Layer) -> None:
        """Scans a layer and those decoded from it until nothing new appears."""
        work = [first]
        while work:
            layer = work.pop()
            if not layer.text:
                continue
            key = (hashlib.sha256(layer.text.encode("utf-8", "surrogatepass")).digest(), *layer.span(0, len(layer.text)))
            if key in self.seen:
                continue
            self.seen.add(key)
            whole = layer.one is None and layer.made.find(1) < 0  # nothing decoded in it: its finds are the base
            for a, kind, b in [] if whole else find(layer.text):
                if layer.one is not None:
                    self.found.add((layer.one[0], kind, layer.one[1]))
                elif layer.made.find(1, a, b) >= 0:
                    self.found.add((layer.start[a], kind, max(layer.end[b - 1], layer.end[a])))
            for pattern, decode, mark in ((_PERCENT, _percent, "%"), (_ESCAPE, _escapes, "\\")):
                if mark in layer.text:
                    deeper, raw = _replaced(layer, pattern, decode)
                    if raw:
                        work += self.percent_values(layer)
                    if deeper is not None:
                        work.append(deeper)
            work += self.base64_layers(layer)

    def unpacked(self, raw: bytes, one: tuple[int, int]) -> _Stream:
        stream = _Stream(_Hidden(self, one, ()))
        stream.feed(raw)
        stream.close()
        return stream

    def stretches(self, raw: bytes, places, end: int) -> list[Layer]:
        """The readable stretches of decoded bytes as layers, the streams in them unpacked.

        ``places`` gives the places of bytes by their numbers; a stream's span goes on to ``end``.
        """
        out, done = [], 0
        for m in _STRETCH.finditer(raw):
            if m.end() - m.start() >= MIN_READABLE:
                text = m.group().decode("utf-8")
                out.append(_mapped(text, m.group(), *places(np.arange(m.start(), m.end()))))
        for m in _MAGIC.finditer(raw):
            if m.start() >= done:
                stream = self.unpacked(raw[m.start() :], (int(places(np.array([m.start()]))[0][0]), end))
                if stream.covers():
                    done = len(raw) - max(stream.left, 0)
        return out

    def percent_values(self, layer: Layer) -> list[Layer]:
        """The layers of whole percent-encoded values that hold bytes which are not text."""
        out = []
        for m in _VALUE.finditer(layer.text):
            body = m.group().encode("ascii")
            raw = unquote_to_bytes(body)
            try:
                raw.decode("utf-8")
                continue  # decoded in place
            except UnicodeDecodeError:
                pass
            coded = np.frombuffer(body, dtype=np.uint8) == 37
            first = np.ones(len(body), dtype=bool)
            first[1:] &= ~coded[:-1]
            first[2:] &= ~coded[:-2]
            begin = np.flatnonzero(first)
            last = begin + 2 * coded[begin]

            def places(k: np.ndarray, begin=begin + m.start(), last=last + m.start()) -> tuple[np.ndarray, np.ndarray]:
                return layer.places(begin[k], last[k])

            out += self.stretches(raw, places, layer.span(m.start(), m.end())[1])
        return out

    def base64_run(self, layer: Layer, body: str, at) -> list[Layer]:
        """The layers of one run; ``at``: the place of each of its characters in the layer."""
        end = layer.one[1] if layer.one else layer.end[int(at[-1])]

        def places(shift: int):  # of bytes, decoded from character `shift` on
            def run(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                return layer.places(at_[shift + k * 4 // 3], at_[shift + (k * 8 + 7) // 6])

            at_ = np.arange(at.start, at.stop) if isinstance(at, range) else at
            return run

        raw = _bytes(body)
        if raw is not None:
            text = _readable(raw)
            if text is not None:
                return [_mapped(text, raw, *places(0)(np.arange(len(raw))))]
            if _MAGIC.match(raw) and self.unpacked(raw, (layer.one or (layer.start[int(at[0])],))[:1] + (end,)).covers():
                return []
        out = []
        for shift in range(4):
            part = body[shift:]
            out += self.stretches(_bytes(part[:-1] if len(part) % 4 == 1 else part) or b"", places(shift), end)
        return out

    def base64_layers(self, layer: Layer) -> list[Layer]:
        out = []
        for m in _BASE64.finditer(layer.text):
            body = m.group().rstrip("=")
            out += self.base64_run(layer, body, range(m.start(), m.start() + len(body)))
        for m in _LINES.finditer(layer.text):
            codes = np.frombuffer(m.group().encode("ascii"), dtype=np.uint8)
            keep = np.flatnonzero(~np.isin(codes, np.frombuffer(b" \t\r\n=", dtype=np.uint8)))
            out += self.base64_run(layer, codes[keep].tobytes().decode("ascii"), keep + m.start())
        return out


def _suspect(text: str) -> bool:
    return "%" in text or "\\" in text or _BASE64.search(text) is not None


def scan(text: str, limit: int | None = None) -> tuple[list[Span], list[Span], int]:
    """Base spans, all spans (both sorted), and the number of streams that were left unscanned.

    ``limit``: give up a stream beyond so many unpacked bytes (None: none is given up).
    """
    base = sorted(find(text))
    if not _suspect(text):
        return base, base, 0
    job = _Scan(limit)
    job.all_of(_whole(text))
    return base, sorted(job.found.union(base)), job.unscanned


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan_all(limit: int | None):
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            base, spans, over = scan(t or "", limit)
            counts = [sum(1 for x in base if x[1] == k) for k in range(3)]
            out.append({"n_assign": counts[0], "n_access": counts[1], "n_hex": counts[2], "base_spans": _joined(base), "spans": _joined(spans), "n_unscanned": over})
        kind = pa.struct([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_spans", pa.string()), ("spans", pa.string()), ("n_unscanned", pa.int64())])
        found = pa.array(out, type=kind)
        give_back()
        return found

    return run


_STRUCT = "struct<n_assign:bigint,n_access:bigint,n_hex:bigint,base_spans:string,spans:string,n_unscanned:bigint>"


def secrets(text: Column | str, limit: int | None = None) -> Column:
    """One struct for each text: base counts, base spans, all spans, layers left unscanned."""
    return F.arrow_udf(_scan_all(limit), _STRUCT).asNondeterministic()(text)


def scan_secrets(docs: DataFrame, *, text: str = "text", limit: int | None = None) -> tuple[DataFrame, str]:
    """``docs`` with the struct of ``secrets`` added; returns it and the new column's name."""
    ship(docs.sparkSession)
    at = fresh("secrets", docs.columns)
    return docs.withColumn(at, secrets(F.col(text), limit)), at


def _mask(text: str | None, mark: str, limit: int | None) -> str | None:
    if not text:
        return text
    out, at = [], 0
    for a, _, b in scan(text, limit)[1]:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def masked(text: Column | str, mark: str = "[SECRET]", limit: int | None = None) -> Column:
    """The text with every found span (overlapping ones as one) replaced by ``mark``; null stays null."""

    def run(texts: pa.Array) -> pa.Array:
        out = pa.array([_mask(t, mark, limit) for t in texts.to_pylist()], type=pa.string())
        give_back()
        return out

    return F.arrow_udf(run, "string").asNondeterministic()(text)
