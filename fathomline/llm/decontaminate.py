"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items become token sequences (lower-cased words). Every run of ``seed`` tokens
is a seed; documents and items meet where they share one. For each such pair the tiling repeats: find the
greatest length at which a run of unmarked tokens matches, by halving between ``seed`` and the length before
(running Karp-Rabin hashes of all runs of a length come from sums taken once a text); go through the matches of
that length from the left, confirm each token by token, and mark it as a tile if it overlaps no earlier one;
until no match of ``seed`` tokens is left. The share of an item's tokens under tiles is its coverage; the
order of tiles does not matter, so reordered passages are caught. A document is contaminated by the
items whose coverage reaches ``threshold``.

Only the places of a text that begin a seed of the item are looked at, all at once, and a round of one length is
one pass over them, however often the text repeats itself; an item has few lengths of tiles.

If the benchmark's tokens fit the checked bound ``ship_bytes``, its sequences and seeds are shipped to
the tasks and the documents are neither shuffled nor copied. Beyond it, seeds are joined by shuffle:
document seeds (distinct in a document) against item seeds, then pairs against texts. Both ways give
the same rows, also where ids are null or repeated; a seed that many documents share costs one row a document in either.

Null or empty texts, and items of fewer than ``seed`` tokens, match nothing, unless such a short item
is found whole: its own length is its seed. Items without tokens never match. Repeated documents each
get their row; empty tables give clean documents; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, kept_rows, output, written
from .words import word_hashes

SEED, THRESHOLD = 5, 0.5
BATCH_BYTES = 4_000_000
#: Largest benchmark, in bytes of text, whose sequences are shipped to every worker.
SHIP_BYTES = 32 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


_OUTER = ".,;:!?\"'()[]{}*#$%&|"


def _fold(word: bytes) -> bytes:
    return word.decode("utf-8").lower().strip(_OUTER).encode("utf-8")


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-cased words without outer punctuation, and where each text's begin (and the last ends)."""
    return word_hashes(texts, _fold)


def _each(texts: pa.Array) -> list[np.ndarray]:
    hashed, ends = token_hashes(texts)
    return [hashed[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


class Runs:
    """Karp-Rabin hashes of a text's runs of any length, each from two sums."""

    def __init__(self, tokens: np.ndarray):
        self.tokens = tokens
        with np.errstate(over="ignore"):
            self.powers = np.full(len(tokens) + 1, BASE, np.uint64)
            self.powers[0] = 1
            self.powers = np.multiply.accumulate(self.powers)
            # sum of token * BASE**-i up to each place; a run is a difference, scaled to one power
            back = np.full(len(tokens), np.uint64(pow(int(BASE), -1, 1 << 64)), np.uint64)
            back[:1] = 1
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens * np.multiply.accumulate(back), dtype=np.uint64)])

    def hashes(self, length: int, at: np.ndarray | None = None) -> np.ndarray:
        """Of the runs that begin at the places, or of all."""
        with np.errstate(over="ignore"):
            if at is None:
                n = max(len(self.tokens) - length + 1, 0)
                mixed = (self.sums[length : length + n] - self.sums[:n]) * self.powers[:n]
            else:
                mixed = (self.sums[at + length] - self.sums[at]) * self.powers[at]
            return mixed ^ (mixed >> np.uint64(29))


def windows(tokens: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``length`` tokens."""
    return Runs(tokens).hashes(length)


def _free(marked: np.ndarray, length: int, at: np.ndarray) -> np.ndarray:
    """Those of the places where runs of unmarked tokens begin."""
    at = at[at + length <= len(marked)]
    sums = np.concatenate([[0], np.cumsum(marked)])
    return at[sums[at + length] == sums[at]]


def _held(sorted_hashes: np.ndarray, found: np.ndarray) -> np.ndarray:
    if not len(sorted_hashes):
        return np.zeros(len(found), bool)
    return sorted_hashes[np.minimum(np.searchsorted(sorted_hashes, found), len(sorted_hashes) - 1)] == found


def tile(doc: np.ndarray | Runs, item: np.ndarray | Runs, seed: int) -> list[tuple[int, int, int]]:
    """Tiles (place in doc, place in item, length), longest first, of one length from the left, none overlapping in either."""
    doc, item = (x if isinstance(x, Runs) else Runs(x) for x in (doc, item))
    places = np.arange(len(item.tokens))
    starts = np.flatnonzero(_held(np.sort(item.hashes(seed)), doc.hashes(seed)))
    marked_doc, marked_item = np.zeros(len(doc.tokens), bool), np.zeros(len(item.tokens), bool)
    tiles: list[tuple[int, int, int]] = []
    most = min(len(doc.tokens), len(item.tokens))

    def matching(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the text whose free runs match a free run of the item; the item's free runs and their hashes."""
        at = _free(marked_item, length, places)
        own = item.hashes(length, at)
        free = _free(marked_doc, length, starts)
        return free[_held(np.sort(own), doc.hashes(length, free))], at, own

    while True:
        low, high, found = seed - 1, most, None  # a match of a length holds matches of all smaller ones
        while low < high:
            length = high if found is None else (low + high + 1) // 2
            got = matching(length)
            if len(got[0]):
                low, found = length, got
            else:
                high, found = length - 1, found or ()
        if low < seed:
            return tiles
        _mark(doc, item, low, *found, marked_doc, marked_item, tiles)
        most = low - 1  # all that is left is shorter


def _mark(doc: Runs, item: Runs, length: int, starting: np.ndarray, at: np.ndarray, own: np.ndarray, marked_doc: np.ndarray, marked_item: np.ndarray, tiles: list) -> None:
    """Marks the tiles of one length, from the left."""
    order = np.argsort(own, kind="stable")
    at, own, hashed = at[order], own[order], doc.hashes(length, starting)
    k = 0
    while k < len(starting) and len(at):
        fits = _held(own, hashed[k : k + 4096])
        if not fits.any():
            k += 4096
            continue
        k += int(fits.argmax())
        d = int(starting[k])
        places = at[np.searchsorted(own, hashed[k]) : np.searchsorted(own, hashed[k], "right")]
        i = next((int(i) for i in places if np.array_equal(doc.tokens[d : d + length], item.tokens[i : i + length])), None)
        if i is None:  # the hash deceived
            k += 1
            continue
        marked_doc[d : d + length] = marked_item[i : i + length] = True
        tiles.append((d, i, length))
        apart = (at + length <= i) | (at >= i + length)
        at, own = at[apart], own[apart]
        k = int(np.searchsorted(starting, d + length))


@dataclass
class _Shipped:
    """Items' tokens end to end, and their seeds in order with the items that hold them."""

    ids: np.ndarray
    tokens: list[np.ndarray]
    seeds: dict[int, tuple[np.ndarray, np.ndarray]]  # by seed length


def _prepared(items: list[tuple[int, str]], seed: int) -> _Shipped:
    hashed, ends = token_hashes(pa.array([t for _, t in items], pa.string()))
    tokens = [hashed[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    held: dict[int, tuple[list, list]] = {}
    for k, t in enumerate(tokens):
        if len(t):
            own = min(seed, len(t))
            found = np.unique(windows(t, own))
            held.setdefault(own, ([], []))[0].append(found)
            held[own][1].append(np.full(len(found), k))
    seeds = {}
    for own, (found, which) in held.items():
        found, which = np.concatenate(found), np.concatenate(which)
        order = np.argsort(found, kind="stable")
        seeds[own] = found[order], which[order]
    return _Shipped(np.asarray([i for i, _ in items], np.int64), tokens, seeds)


def _near(hashed: np.ndarray, ends: np.ndarray, shipped: _Shipped) -> list[tuple[int, list[int]]]:
    """Of each text that shares a seed with any item, the numbers of those items."""
    found: dict[int, set[int]] = {}
    for own, (seeds, which) in shipped.seeds.items():
        runs = windows(hashed, own)
        first = np.searchsorted(seeds, runs)
        hit = np.flatnonzero(seeds[np.minimum(first, len(seeds) - 1)] == runs)
        doc = np.searchsorted(ends, hit, side="right") - 1
        inside = hit + own <= ends[doc + 1]
        hit, doc = hit[inside], doc[inside]
        last = np.searchsorted(seeds, runs[hit], "right")
        for n, a, b in zip(doc.tolist(), first[hit].tolist(), last.tolist(), strict=True):
            found.setdefault(n, set()).update(which[a:b].tolist())
    return [(n, sorted(items)) for n, items in sorted(found.items())]


def _covered(doc: np.ndarray | Runs, item: np.ndarray, seed: int) -> tuple[int, int]:
    tiles = tile(doc, item, min(seed, len(item)))
    return sum(t[2] for t in tiles), len(tiles)


_MATCH = "row long, key long, item_id long, covered long, item_tokens long, tiles long"
_MATCH_ARROW = pa.schema([(n, pa.int64()) for n in ("row", "key", "item_id", "covered", "item_tokens", "tiles")])


def _items(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    return benchmark.select(benchmark[item_col].cast("long").alias("item_id"), benchmark[text_col].cast("string").alias("item_text")).where("item_text IS NOT NULL")


def _bytes(items: DataFrame) -> int:
    return items.agg(F.sum(F.octet_length("item_text") + 16)).first()[0] or 0


def _shared(items: DataFrame, seed: int):
    return items.sparkSession.sparkContext.broadcast(_prepared([(r.item_id, r.item_text) for r in items.orderBy("item_id", "item_text").collect()], seed))


def matches(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", ship_bytes: int = SHIP_BYTES) -> DataFrame:
    """(row, key, item_id, covered, item_tokens, tiles) of documents and items that share a seed; row numbers repeated ids apart."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].cast("long").alias("key"), docs[text_col].cast("string").alias("text"))
    items = _items(benchmark)
    return _by_shipping(rows, items, seed) if _bytes(items) <= ship_bytes else _by_join(written(rows, "tiling-rows"), items, seed)


def _by_shipping(rows: DataFrame, items: DataFrame, seed: int) -> DataFrame:
    shared = _shared(items, seed)

    def tiled(batches):
        shipped = shared.value
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            hashed, ends = token_hashes(batch.column("text"))
            out = []
            for n, items in _near(hashed, ends, shipped):
                doc = Runs(hashed[ends[n] : ends[n + 1]])
                for k in items:
                    covered, tiles = _covered(doc, shipped.tokens[k], seed)
                    out.append((batch.column("row")[n].as_py(), batch.column("key")[n].as_py(), int(shipped.ids[k]), covered, len(shipped.tokens[k]), tiles))
            if out:
                yield output(_MATCH_ARROW, [list(c) for c in zip(*out, strict=True)])

    return rows.mapInArrow(tiled, _MATCH)


def _by_join(rows: DataFrame, items: DataFrame, seed: int) -> DataFrame:
    """The rows must be written: their numbers are read more than once."""
    items = written(items.withColumn("item", F.monotonically_increasing_id()), "tiling-items")
    lengths = pa.schema([("item", pa.int64()), ("size", pa.int32()), ("h", pa.int64())])

    def item_seeds(batches):
        for batch in by_bytes(batches, "item_text", BATCH_BYTES):
            for item, tokens in zip(batch.column("item").to_pylist(), _each(batch.column("item_text")), strict=True):
                if len(tokens):
                    own = min(seed, len(tokens))
                    found = np.unique(windows(tokens, own))
                    yield output(lengths, [[item] * len(found), [own] * len(found), found.view(np.int64)])

    wanted = written(items.mapInArrow(item_seeds, "item long, size int, h long"), "tiling-seeds")
    used = sorted(r.size for r in wanted.select(F.col("size")).distinct().collect())
    doc_schema = pa.schema([("row", pa.int64()), ("size", pa.int32()), ("h", pa.int64())])

    def doc_seeds(batches):
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            for row, tokens in zip(batch.column("row").to_pylist(), _each(batch.column("text")), strict=True):
                for own in used:
                    found = np.unique(windows(tokens, own))
                    if len(found):
                        yield output(doc_schema, [[row] * len(found), [own] * len(found), found.view(np.int64)])

    pairs = rows.select("row", "text").mapInArrow(doc_seeds, "row long, size int, h long").join(wanted, ["size", "h"]).select("row", "item").distinct()
    full = pairs.join(rows, "row").join(items, "item")

    def tiled(batches):
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            out = []
            for row, key, item, doc, tokens in zip(*(batch.column(c).to_pylist() for c in ("row", "key", "item_id")), _each(batch.column("text")), _each(batch.column("item_text")), strict=True):
                covered, tiles = _covered(doc, tokens, seed)
                out.append((row, key, item, covered, len(tokens), tiles))
            if out:
                yield output(_MATCH_ARROW, [list(c) for c in zip(*out, strict=True)])

    return full.select("row", "key", "text", "item_id", "item_text").mapInArrow(tiled, _MATCH)


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, seed: int = SEED, ship_bytes: int = SHIP_BYTES) -> DataFrame:
    """(doc_id, item_id, covered, item_tokens, tiles, coverage) of every document and item at or over the threshold."""
    found = matches(docs, benchmark, seed, ship_bytes=ship_bytes).withColumn("coverage", F.col("covered") / F.col("item_tokens"))
    return found.where(F.col("coverage") >= threshold).withColumnRenamed("key", "doc_id")


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, seed: int = SEED, ship_bytes: int = SHIP_BYTES) -> DataFrame:
    """The documents that no item contaminates, with all their columns; each row is judged by its own text, whatever its id."""
    items = _items(benchmark)
    if _bytes(items) > ship_bytes:
        names = docs.columns
        tagged = written(docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("row", F.monotonically_increasing_id()), "tiling-rows")
        rows = tagged.select("row", F.lit(None).cast("long").alias("key"), F.col(f"c{names.index('text')}").cast("string").alias("text"))
        bad = _by_join(rows, items, seed).where(F.col("covered") / F.col("item_tokens") >= threshold).select("row").distinct()
        return tagged.join(bad, "row", "left_anti").drop("row").toDF(*names)
    shared = _shared(items, seed)

    def untouched(texts: pa.Array) -> np.ndarray:
        shipped = shared.value
        hashed, ends = token_hashes(texts)
        keep = np.ones(len(texts), bool)
        for n, near in _near(hashed, ends, shipped):
            doc = Runs(hashed[ends[n] : ends[n + 1]])
            keep[n] = not any(_covered(doc, shipped.tokens[k], seed)[0] / len(shipped.tokens[k]) >= threshold for k in near)
        return keep

    return kept_rows(docs, "text", untouched, BATCH_BYTES)
