"""Byte-level BPE encoding and decoding from a file of ranks, in two tiers.

A text is cut into units that no match of the pattern spans (see unit_encoder), each distinct unit of a
batch is cut into its matches, and each distinct match is looked up whole: a minimal perfect hash sends
every token's bytes to a slot of its own among exactly as many slots as there are tokens, for all matches
of a batch at once, and the slot's bytes tell whether the match is a token. The rest are merged: their
bytes form a linked list, a heap holds the adjacent pairs by rank and place, and stale pairs are passed over
when they come up, so a match of m bytes takes O(m log m), however long it is. Units keep their ids in a
bounded memo between batches.

Ids leave as little-endian unsigned 32-bit integers in one binary value a text, which is what decoding
takes; decoding gathers the tokens' bytes by id.

Null or empty text: no ids, and decoded empty. Bytes that are no UTF-8 are read as U+FFFD. Repeated rows
each get their own row; an empty table gives an empty table; other columns are not read. Ids that the file
does not have make decoding fail, naming them; a value whose length is not a multiple of four fails too.
"""

from __future__ import annotations

import base64
import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_bytes, output
from .unit_encoder import UnitEncoder
from .words import mix

#: Bytes of text, or of ids, that are worked on at a time.
BATCH_BYTES = 4_000_000
#: The pattern whose units unit_encoder knows; texts are cut only by their own matches under any other.
KNOWN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_OPEN: dict[tuple[str, str], "RankEncoder"] = {}


def rank_encoder(path: str, pattern: str) -> "RankEncoder":
    """The encoder of a rank file, opened once in each Python worker."""
    if (path, pattern) not in _OPEN:
        _OPEN[path, pattern] = RankEncoder(path, pattern)
    return _OPEN[path, pattern]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank; ranks must run from 0 without gaps."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    tokens = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if len(set(tokens.values())) != len(pairs) or sorted(tokens) != list(range(len(pairs))):
        raise ValueError("ranks must run from 0 without gaps, each for a token of its own")
    return [tokens[r] for r in range(len(tokens))]


def _flat(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes end to end, and where each item begins (and the last ends)."""
    ends = np.zeros(len(items) + 1, np.int64)
    np.cumsum([len(i) for i in items], out=ends[1:])
    return np.frombuffer(b"".join(items), np.uint8), ends


def hashes(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each item: a mixed sum of its bytes, each mixed with its place."""
    size = np.diff(ends)
    place = (np.arange(len(raw)) - np.repeat(ends[:-1], size)).astype(np.uint64)
    with np.errstate(over="ignore"):
        each = mix((place << np.uint64(8)) + raw + np.uint64(1))
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)])
        return mix(upto[ends[1:]] - upto[ends[:-1]] + size.astype(np.uint64))


class PerfectHash:
    """A minimal perfect hash of distinct byte strings: key i is alone in one of len(keys) slots.

    A key's hash names its bucket. Buckets of several keys, fullest first, look for the first displacement
    that sends their keys to free slots; buckets of one key are given a free slot by name.
    """

    TRIES = 512

    def __init__(self, keys: list[bytes]):
        self.size = max(len(keys), 1)
        self.raw, self.ends = _flat(keys)
        hashed = hashes(self.raw, self.ends)
        if len(np.unique(hashed)) != len(keys):
            raise ValueError("two keys have one hash")
        self.buckets = max(1, len(keys) // 3)
        self.shift = np.zeros(self.buckets, np.int64)
        self.item = np.full(self.size, -1, np.int64)
        bucket = self._bucket(hashed)
        order = np.argsort(bucket, kind="stable")
        first = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        count = np.diff(first)
        free = np.ones(self.size, bool)
        for b in np.argsort(-count, kind="stable")[: int((count > 1).sum())].tolist():
            own = order[first[b] : first[b + 1]]
            at = 0
            while True:
                slots = self._slot(hashed[own][None, :], np.arange(at, at + self.TRIES)[:, None])
                fits = free[slots].all(axis=1)
                for k in np.flatnonzero(fits).tolist():
                    if len(set(slots[k].tolist())) == len(own):
                        break
                else:
                    at += self.TRIES
                    continue
                self.shift[b], self.item[slots[k]], free[slots[k]] = at + k, own, False
                break
        single = np.flatnonzero(count == 1)
        left = np.flatnonzero(free)[: len(single)]
        self.shift[single] = -1 - left
        self.item[left] = order[first[single]]

    def _bucket(self, hashed: np.ndarray) -> np.ndarray:
        return ((hashed >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)

    def _slot(self, hashed: np.ndarray, shift: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(hashed + shift.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.size)).astype(np.int64)

    def find(self, wanted: list[bytes]) -> np.ndarray:
        """Of each byte string the number of its key, or -1."""
        if not wanted or not len(self.raw):
            return np.full(len(wanted), -1, np.int64)
        raw, ends = _flat(wanted)
        hashed = hashes(raw, ends)
        shift = self.shift[self._bucket(hashed)]
        found = self.item[np.where(shift < 0, -1 - shift, self._slot(hashed, np.maximum(shift, 0)))]
        # a slot is only where the key would be: its bytes decide
        size = np.diff(ends)
        same = np.diff(self.ends)[found] == size
        rows = np.flatnonzero(same)
        upto = np.cumsum(size[rows])
        step = np.arange(upto[-1] if len(rows) else 0)
        theirs = np.repeat(self.ends[found[rows]] - upto + size[rows], size[rows]) + step
        ours = np.repeat(ends[:-1][rows] - upto + size[rows], size[rows]) + step
        wrong = np.concatenate([[0], np.cumsum(self.raw[theirs] != raw[ours])])
        same[rows] = wrong[upto] == wrong[upto - size[rows]]
        return np.where(same, found, -1)


class RankEncoder(UnitEncoder):
    """Units as in unit_encoder; their ids come from the two tiers."""

    def __init__(self, path: str, pattern: str, most_units: int = 400_000):
        import regex

        self.tokens = read_ranks(path)
        self.whole = PerfectHash(self.tokens)
        self.raw, self.ends = self.whole.raw, self.whole.ends
        self.matches = regex.compile(pattern).findall
        self.kind, self.lower, self.specials = "byte", False, []
        self.by_units = pattern == KNOWN_PATTERN
        self.dtype = np.dtype("<u2") if len(self.tokens) <= 1 << 16 else np.dtype("<u4")
        self.most_units = most_units
        single = {t[0]: r for r, t in enumerate(self.tokens) if len(t) == 1}
        if len(single) != 256:
            raise ValueError("each byte must be a token")
        self.byte = [single[b] for b in range(256)]
        self.pairs = self._pairs()
        self._forget()

    def _pairs(self) -> dict[int, int]:
        """The rank of every two tokens whose bytes are a token together, by the two ranks in one number."""
        cuts = [(r, k) for r, t in enumerate(self.tokens) for k in range(1, len(t))]
        left = self.whole.find([self.tokens[r][:k] for r, k in cuts])
        right = self.whole.find([self.tokens[r][k:] for r, k in cuts])
        return {(a << 32) | b: r for a, b, (r, _) in zip(left.tolist(), right.tolist(), cuts, strict=True) if a >= 0 and b >= 0}

    def merged(self, match: bytes) -> list[int]:
        """The ids of a match that is no token: of all adjacent pairs the lowest rank, leftmost first, is merged until none is left."""
        pair, rank = self.pairs.get, [self.byte[b] for b in match]
        n = len(rank)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # rank and place in one number, so that the heap compares numbers
        heap = [r << 32 | i for i in range(n - 1) if (r := pair(rank[i] << 32 | rank[i + 1], -1)) >= 0]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            least = pop(heap)
            r, i = least >> 32, least & 0xFFFFFFFF
            j = after[i]
            if rank[i] < 0 or j >= n or pair(rank[i] << 32 | rank[j]) != r:
                continue  # one of the two has been merged since
            rank[i], rank[j] = r, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (own := pair(r << 32 | rank[k], -1)) >= 0:
                    push(heap, own << 32 | i)
            if (h := before[i]) >= 0 and (own := pair(rank[h] << 32 | r, -1)) >= 0:
                push(heap, own << 32 | h)
        return [r for r in rank if r >= 0]

    def _cuts(self, raw: np.ndarray) -> np.ndarray:
        return super()._cuts(raw) if self.by_units else np.zeros(len(raw), bool)

    def _numbers(self, units: list[bytes]) -> np.ndarray:
        """Of each distinct unit, its number in the memo."""
        known = self.known
        new = [u for u in units if u not in known]
        if new and len(known) + len(new) > self.most_units:
            self._keep_used()
            known = self.known
            new = [u for u in units if u not in known]
        if new:
            split = [[m.encode("utf-8") for m in self.matches(u.decode("utf-8", "replace"))] for u in new]
            distinct = dict.fromkeys(chain.from_iterable(split))
            for match, rank in zip(distinct, self.whole.find(list(distinct)).tolist(), strict=True):
                distinct[match] = [rank] if rank >= 0 else self.merged(match)
            got = [list(chain.from_iterable(distinct[m] for m in matches)) for matches in split]
            known.update(zip(new, range(len(known), len(known) + len(got)), strict=True))
            length = np.fromiter(map(len, got), np.int32, len(got))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(length, dtype=np.int64) - length])
            self.lengths = np.concatenate([self.lengths, length])
            self.uses = np.concatenate([self.uses, np.zeros(len(got), np.int32)])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(got), self.dtype, int(length.sum()))])
        numbers = np.fromiter(map(known.__getitem__, units), np.int64, len(units))
        self.uses[numbers] += 1
        return numbers

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids, and where each id's begin (and the last's end)."""
        if len(ids) and int(ids.max()) >= len(self.tokens):
            raise ValueError(f"the file has no token {int(ids.max())}")
        size = np.diff(self.ends)[ids]
        upto = np.concatenate([[0], np.cumsum(size)])
        raw = np.empty(upto[-1], np.uint8)
        for a in range(0, len(ids), 1 << 18):  # places of bytes take eight times the bytes
            b = min(a + (1 << 18), len(ids))
            raw[upto[a] : upto[b]] = self.raw[np.repeat(self.ends[:-1][ids[a:b]] - upto[a:b] + upto[a], size[a:b]) + np.arange(upto[b] - upto[a])]
        return raw, upto


def encode_texts(docs: DataFrame, ranks: str, pattern: str = KNOWN_PATTERN, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(id, n_tokens, ids) of each row; ids: binary, little-endian unsigned 32-bit; ranks: path of a rank file on every worker.

    With ``decoded`` one column more: the bytes that decode_ids gives for the ids, made in the same pass.
    """
    schema = pa.schema([("key", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.large_binary()), *([("decoded", pa.large_binary())] if decoded else [])])

    def encoded(batches):
        for batch in by_bytes(batches, "text", batch_bytes):
            known = rank_encoder(ranks, pattern)
            ids, ends = known.encode(batch.column("text"))
            columns = [batch.column("key"), np.diff(ends), _binaries(ids.astype("<u4").view(np.uint8), 4 * ends)]
            if decoded:
                raw, upto = known.decode(ids)
                columns.append(_binaries(raw, upto[ends]))
            yield output(schema, columns)

    rows = docs.select(docs[id_col].cast("long").alias("key"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(encoded, "key long, n_tokens long, ids binary" + (", decoded binary" if decoded else "")).withColumnRenamed("key", id_col)


def decode_ids(rows: DataFrame, ranks: str, pattern: str = KNOWN_PATTERN, ids_col: str = "ids", decoded_col: str = "decoded", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """The rows with the bytes of their ids in one more column."""
    names = rows.columns
    plain = rows.toDF(*[f"c{i}" for i in range(len(names))])
    at = f"c{names.index(ids_col)}"

    def decoded(batches):
        for batch in by_bytes(batches, at, batch_bytes):
            values = batch.column(at).cast(pa.large_binary()).fill_null(b"")
            offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
            if (np.diff(offsets) % 4).any():
                raise ValueError("ids must be 32-bit integers")
            data = values.buffers()[2]
            ids = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].copy().view("<u4") if data is not None else np.zeros(0, "<u4")
            raw, upto = rank_encoder(ranks, pattern).decode(ids)
            out = _binaries(raw, upto[(offsets - offsets[0]) // 4])
            yield pa.RecordBatch.from_arrays([*batch.columns, out.cast(pa.binary()) if len(raw) < 1 << 31 else out], names=[*batch.schema.names, "decoded"])

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)
    return plain.mapInArrow(decoded, f"{shape}, decoded binary").toDF(*names, decoded_col)


def _binaries(raw: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])
