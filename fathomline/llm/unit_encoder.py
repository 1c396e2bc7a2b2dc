"""Exact token ids of whole texts, by way of the distinct units of a batch.

A text is cut at boundaries that no pre-token of the tokenizer can span, so the ids of the text are
the ids of its units in order. Each distinct unit of a batch is given to the tokenizers library once;
a bounded memo keeps units between batches. Cutting, counting distinct units and gathering the ids
are Arrow and numpy operations over the whole batch.

Boundaries, for both supported pre-tokenizers:

* between a letter of ASCII or Latin-1 and an ASCII character that is neither letter nor apostrophe;
* ``word`` kind (white space is dropped): on both sides of a blank or line feed;
* ``byte`` kind (a blank belongs to the word after it): before a blank or line feed that follows a
  visible character, and after a single line feed between two. Other runs of white space stay with
  what follows them.

Texts that hold the first characters of an added special token are given to the library whole.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalpha() and chr(c) != "'"]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[10, 32]] = True
_VISIBLE = np.zeros(256, bool)
_VISIBLE[33:127] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TWO_BYTE = np.zeros(256, bool)
_TWO_BYTE[0xC3:0xE0] = True

_LATIN_1 = np.zeros(256, bool)  # second bytes of the letters of Latin-1; 0x97 and 0xB7 are the signs for times and division
_LATIN_1[[c for c in range(0x80, 0xC0) if c not in (0x97, 0xB7)]] = True

_ONE = {"word": re.compile("[a-zß-öø-ÿ]+"), "byte": re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")}

_OPEN: dict[str, "UnitEncoder"] = {}


def encoder(path: str) -> "UnitEncoder":
    """The encoder of a tokenizer file, opened once in each Python worker."""
    if path not in _OPEN:
        _OPEN[path] = UnitEncoder(path)
    return _OPEN[path]


class UnitEncoder:
    def __init__(self, path: str, most_units: int = 400_000):
        """most_units: bound of the memo; the less used half is forgotten beyond that."""
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.kind = _kind(spec)
        self.lower = self.kind == "word"
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.dtype = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.most_units = most_units
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, self.dtype)
        self.uses = np.zeros(0, np.int32)  # batches that held a unit, halved whenever units are forgotten

    def _keep_used(self) -> None:
        """Forget the less used half of the units."""
        names = list(self.known)
        at = np.sort(np.argsort(-self.uses, kind="stable")[: self.most_units // 2])
        length = self.lengths[at]
        flat = self._gather(self.starts[at], length)
        self.known = {names[i]: k for k, i in enumerate(at.tolist())}
        self.starts, self.lengths, self.flat = np.cumsum(length, dtype=np.int64) - length, length, flat
        self.uses = self.uses[at] // 2

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the positions where each text begins (and the last ends)."""
        if self.kind == "whole":
            return self._whole(texts)
        held = [bool(self.specials) and t is not None and any(s[:2] in t for s in self.specials) for t in texts.to_pylist()] if self._may_hold_special(texts) else None
        if held is None or not any(held):
            return self._by_units(texts)
        parts, lengths = [], np.zeros(len(texts), np.int64)
        at = 0
        while at < len(texts):  # runs of plain texts between texts given whole
            end = at
            while end < len(texts) and held[end] == held[at]:
                end += 1
            ids, ends = (self._whole if held[at] else self._by_units)(texts.slice(at, end - at))
            parts.append(ids)
            lengths[at:end] = np.diff(ends)
            at = end
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(lengths)])

    def _may_hold_special(self, texts: pa.Array) -> bool:
        import pyarrow.compute as pc

        return any(pc.any(pc.match_substring(texts, s[:2])).as_py() for s in self.specials)

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        out = [e.ids for e in self.library.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in out], dtype=np.int64)])
        return np.fromiter(chain.from_iterable(out), self.dtype, int(ends[-1])), ends

    def _by_units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, offsets = _bytes_of(texts)
        if not len(raw):
            return np.zeros(0, self.dtype), np.zeros(len(texts) + 1, np.int64)
        if self.lower:
            raw = _LOWER[raw]
            raw[raw == 10] = 32
        cuts = self._cuts(raw)
        cuts[offsets[(offsets > 0) & (offsets < len(raw))]] = True
        cuts[0] = True
        starts = np.flatnonzero(cuts)
        ends = np.append(starts, len(raw)).astype(np.int32)
        units = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
        which = units.indices.to_numpy()
        number = self._numbers(units.dictionary.to_pylist())[which]
        length = self.lengths[number]
        upto = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
        return self._gather(self.starts[number], length), upto[np.searchsorted(starts, offsets)]

    def _gather(self, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The ids of units, given where each begins and how many it has."""
        upto = np.cumsum(length, dtype=np.int64)
        where = np.repeat(first - upto + length, length)
        where += np.arange(len(where))
        return self.flat[where]

    def _cuts(self, raw: np.ndarray) -> np.ndarray:
        letter, mark, blank = _LETTER[raw], _MARK[raw], _BLANK[raw]
        cuts = np.zeros(len(raw), bool)
        left, right = slice(None, -1), slice(1, None)
        latin = (raw[left] == 0xC3) & _LATIN_1[raw[right]]  # its first byte on the left
        opens, closes = letter.copy(), letter
        opens[left] |= latin
        closes[right] |= latin
        cuts[right] = (closes[left] & mark[right]) | (mark[left] & opens[right])
        if self.kind == "word":
            # a blank goes with the unit before it, and is stripped before encoding
            cuts[right] |= blank[left] & ~blank[right]
        else:
            seen = _VISIBLE[raw]
            seen[1:] |= _TWO_BYTE[raw[:-1]] & (raw[1:] >= 0x80)
            cuts[right] |= seen[left] & blank[right]
            # a single line feed between visible characters is a pre-token of its own
            cuts[2:] |= seen[:-2] & (raw[1:-1] == 10) & seen[2:] & _VISIBLE[raw[2:]]
        return cuts

    def _numbers(self, units: list[bytes]) -> np.ndarray:
        """Of each distinct unit, its number in the memo."""
        keys = [u.decode("utf-8") for u in units]
        if self.kind == "word":
            keys = [k.strip(" ") for k in keys]
        known, one = self.known, _ONE[self.kind].fullmatch
        new = dict.fromkeys(k for k in keys if k not in known)
        if new and len(known) + len(new) > self.most_units:
            self._keep_used()
            known = self.known
            new = dict.fromkeys(k for k in keys if k not in known)
        direct, rest = [], []
        for k in new:
            (direct if one(k) else rest).append(k)
        # such units are one pre-token each, so only the model's step is left of the library's work
        step = self.library.model.tokenize
        got = [[t.id for t in step(k if k.isascii() and k[0] != " " else _byte_level(k))] for k in direct]
        got += [e.ids for e in self.library.encode_batch_fast(rest, add_special_tokens=False)] if rest else []
        if got:
            known.update(zip(direct + rest, range(len(known), len(known) + len(got)), strict=True))
            length = np.fromiter(map(len, got), np.int32, len(got))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(length, dtype=np.int64) - length])
            self.lengths = np.concatenate([self.lengths, length])
            self.uses = np.concatenate([self.uses, np.zeros(len(got), np.int32)])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(got), self.dtype, int(length.sum()))])
        numbers = np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))
        self.uses[numbers] += 1
        return numbers


#: A byte-level vocabulary writes the bytes that are not printable in Latin-1 as the characters from U+0100 on, in order.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def _byte_level(unit: str) -> str:
    return unit.encode("utf-8").decode("latin-1").translate(_SHOWN)


def _kind(spec: dict) -> str:
    """byte or word, for the two pre-tokenizers whose boundaries are known; whole for any other."""
    pre, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in spec["added_tokens"]) or any(c.isspace() for t in spec["added_tokens"] for c in t["content"]):
        return "whole"
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and normal is None:
        return "byte"
    steps = [s.get("type") for s in (normal or {}).get("normalizers", [])]
    parts = pre.get("pretokenizers", [])
    if steps == ["NFC", "Replace", "Lowercase"] and [p.get("type") for p in parts] == ["Split", "ByteLevel"] and parts[0].get("invert") and parts[0].get("behavior") == "Removed":
        return "word"
    return "whole"


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes without gaps, and where each begins (and the last ends); null is empty."""
    import pyarrow.compute as pc

    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return raw, (offsets - offsets[0]) if len(texts) else np.zeros(1, np.int64)
