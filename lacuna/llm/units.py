"""Units of a text: stretches that no token of the given vocabularies crosses, each distinct one tokenised once.

A cut stands before a space that follows no space and is followed by a character other than white space, between an ASCII
letter and a mark after it, before a line feed after either, and after one between them.  Byte-level BPE splits there by its pattern
(white space before a word ends at its last space, which opens the word; letters, marks and white space go apart); piece
BPE cannot merge across a cut where no piece holds the two characters side by side.  So a text's tokens are those of its
units, one after another.  ``byte_level_cuts`` and ``piece_cuts`` hold a vocabulary against these conditions; where one fails, a
text is one unit.
"""

from __future__ import annotations

import codecs
import json
import os
import re
from collections.abc import Callable

import numpy as np

from .text import prefix_sums, span_hash

MOST_UNITS = 1 << 18  # distinct units a Python worker remembers; beyond it those met once are forgotten, or all

#: Bytes that may open a white-space character (ASCII controls and space; leads of U+0085, U+00A0, U+1680, U+2000.., U+3000).
_MAYBE_SPACE = np.zeros(256, dtype=bool)
_MAYBE_SPACE[:33] = True
_MAYBE_SPACE[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def task_tokenizer(path: str):
    """A tokenizer of the tokenizers library that works on its task's core alone: threads of its own would hold memory each."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


def byte_level_alphabet() -> dict[str, int]:
    """Character to byte of byte-level vocabularies: printable Latin-1 stands for itself, the others follow from U+0100."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(rest)}


#: Neighbours that no piece may hold for the cuts to be safe.
_JOINED = re.compile(r"[^▁]▁|[A-Za-z][!-/:-@\[-`{-~]|\n.|.\n", re.DOTALL)


def byte_level_cuts(path: str) -> bool:
    """Whether the vocabulary file is byte-level BPE with the standard pattern, no normaliser and no added prefix."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before = spec.get("pre_tokenizer") or {}
    return (
        spec["model"].get("type") == "BPE"
        and spec.get("normalizer") is None
        and before.get("type") == "ByteLevel"
        and before.get("use_regex", True)
        and not before.get("add_prefix_space", False)
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", []))
    )


def piece_cuts(path: str) -> bool:
    """Whether the model is piece BPE that keeps texts as they are and has no piece with a space mark after its front."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    how, kind = model.normalizer_spec, pb.ModelProto.SentencePiece
    return (
        model.trainer_spec.model_type == pb.TrainerSpec.BPE
        and not how.precompiled_charsmap
        and how.add_dummy_prefix
        and not how.remove_extra_whitespaces
        and not model.trainer_spec.treat_whitespace_as_suffix
        and all(p.type in (kind.NORMAL, kind.UNKNOWN, kind.CONTROL, kind.BYTE) for p in model.pieces)
        and not any(_JOINED.search(p.piece) for p in model.pieces if p.type == kind.NORMAL)
    )


_MARK = np.zeros(256, dtype=bool)
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


#: Units that the byte-level pattern does not split: letters, digits or marks, with at most one space before.
_ONE_STRETCH = re.compile(rb" ?[A-Za-z]+| ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+| ?[0-9]+| ?[!-/:-@\[-`{-~]+|\n")


def unit_ids(tokenizer, new: list[bytes], cut: bool, alphabet: list[str]) -> list[list[int]]:
    """Ids of units by a byte-level tokenizer of the tokenizers library; ``alphabet`` has the character of each byte."""
    found: list[list[int]] = [[]] * len(new)
    one = [k for k, u in enumerate(new) if _ONE_STRETCH.fullmatch(u)] if cut else []
    if one:  # the pattern leaves these whole: their ids come from the merges alone
        merge = tokenizer.model.tokenize
        letters = codecs.charmap_decode(b"\0".join([new[k] for k in one]), "strict", "".join(alphabet))[0]  # they hold no byte 0
        for k, u in zip(one, letters.split(alphabet[0])):
            found[k] = [t.id for t in merge(u)]
    whole = [k for k, ids in enumerate(found) if not ids]
    for at in range(0, len(whole), 1000):
        some = whole[at : at + 1000]
        for k, e in zip(some, tokenizer.encode_batch([new[k].decode() for k in some], add_special_tokens=False)):
            found[k] = e.ids
    return found


def unit_starts(data: np.ndarray, offsets: np.ndarray, cut: bool = True) -> np.ndarray:
    """First byte of every unit, rows being cut at ``offsets``; empty rows have no unit."""
    opens = np.zeros(len(data) + 1, dtype=bool)
    opens[offsets] = True
    opens[-1] = False
    if cut and len(data) > 2:
        # a space that ends a row is followed by another row's character
        opens[1:-2] |= (data[1:-1] == 32) & (data[:-2] != 32) & ~_MAYBE_SPACE[data[2:]] & ~opens[2:-1]
        opens[1:-1] |= _LETTER[data[:-1]] & _MARK[data[1:]]
        line = data == 10
        plain = _LETTER[data] | _MARK[data]
        opens[1:-1] |= plain[:-1] & line[1:]
        opens[2:-1] |= plain[:-2] & line[1:-1] & plain[2:]  # white space of more than one character is split by what follows
    return np.flatnonzero(opens)


class UnitTable:
    """Numbers of distinct units by their 64-bit content hash, bounded; ``learn`` is told of new units first."""

    def __init__(self, learn: Callable[[list[bytes]], None], clear: Callable[[], None], most: int = MOST_UNITS):
        self._learn, self._clear, self.most = learn, clear, most
        self._empty()

    def _empty(self) -> None:
        self.keys, self.numbers, self.again = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)

    def full(self) -> bool:
        return len(self.keys) > self.most

    def clear(self) -> None:
        self._empty()
        self._clear()

    def trim(self) -> np.ndarray:
        """Forgets units met in one look-up only, or all where others fill half of the table.

        Returns the numbers of those that stay; they are numbered anew in this order.
        """
        kept = np.flatnonzero(self.again)
        kept = kept if 2 * len(kept) <= self.most else kept[:0]
        was = self.numbers[kept]
        self.keys, self.numbers, self.again = self.keys[kept], np.arange(len(kept)), np.zeros(len(kept), bool)
        return was

    def look_up(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The number of each unit; ``starts`` ascending, a unit ends where the next starts, the last at the end."""
        if not len(starts):
            return np.zeros(0, dtype=np.int64)
        ends = np.r_[starts[1:], len(data)]
        keys, where, back = np.unique(span_hash(prefix_sums(data), starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        self.again[at[~new]] = True
        if new.any():
            raw = data.tobytes()
            self._learn([raw[a:b] for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist())])
            number = len(self.numbers) + np.arange(int(new.sum()))
            self.keys, self.numbers = np.insert(self.keys, at[new], keys[new]), np.insert(self.numbers, at[new], number)
            self.again = np.insert(self.again, at[new], False)
            at = np.searchsorted(self.keys, keys)
        return self.numbers[at][back]


class Runs:
    """Ragged rows of numbers that grow by appending: row ``i`` is ``values[start[i] : start[i + 1]]``."""

    def __init__(self, dtype):
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self._values, self._counts, self._start = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)], np.zeros(0, np.int64)

    def add(self, values: np.ndarray, counts: np.ndarray) -> None:
        self._values.append(np.asarray(values, self.dtype))
        self._counts.append(np.asarray(counts, np.int64))

    def _whole(self, parts: list[np.ndarray]) -> np.ndarray:
        if len(parts) > 1:
            parts[:] = [np.concatenate(parts)]
        return parts[0]

    @property
    def values(self) -> np.ndarray:
        return self._whole(self._values)

    @property
    def counts(self) -> np.ndarray:
        return self._whole(self._counts)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the given rows, one after another, and each row's number of values."""
        counts = self.counts
        if len(self._start) < len(counts):
            self._start = np.cumsum(counts) - counts
        many, start = counts[rows], self._start
        to = np.cumsum(many)
        total = int(to[-1]) if len(to) else 0
        return self.values[np.repeat(start[rows] - (to - many), many) + np.arange(total)], many


def sums_per_row(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Exact integer sums of ``values`` between neighbouring entries of ``cut``."""
    return np.diff(np.r_[0, np.cumsum(values, dtype=np.int64)][cut])
