"""Ordered folds as associative scans: a key's log is cut where it is long, and its parts are folded side by side.

The numbers of a state move by maps that are linear in pieces: an average is one piece, a step within bounds has
pieces where it is clamped, a token taken or refused is a jump. Such maps compose into maps of the same kind,
and composition is associative, so what a stretch of a log does to any state is known without the state.

Rows are dealt by ranges of (key, order), which cuts long logs, and checkpointed, so that all passes see
the same parts. Only keys that go on from one part to the next are composed: each part of theirs sends one
map (at most two of them a part), and the maps are chained in order on the driver, whose work is the number
of parts. Then every part is folded from its known beginning, and no task reads more than its part.

Where a beginning was composed its last bits may differ from those of one long fold, as additions were grouped
in another way; all else is the fold itself. Rows that tie in (key, order) stay together; a null key is a
key; an empty table gives an empty one.
"""

from __future__ import annotations

import bisect
import math
import pickle
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..scratch import checkpointed

#: (start, a, b) by start, the first from minus infinity: a number from start on becomes a * number + b.
Pieces = list[tuple[float, float, float]]

SAME: Pieces = [(-math.inf, 1.0, 0.0)]


def linear(a: float, b: float) -> Pieces:
    return [(-math.inf, a, b)]


def at_most(limit: float) -> Pieces:
    return [(-math.inf, 1.0, 0.0), (limit, 0.0, limit)]


def at_least(limit: float) -> Pieces:
    return [(-math.inf, 0.0, limit), (limit, 1.0, 0.0)]


def value(pieces: Pieces, number: float) -> float:
    _, a, b = pieces[bisect.bisect_right(pieces, (number, math.inf, math.inf)) - 1]
    return a * number + b if a else b


def then(first: Pieces, second: Pieces) -> Pieces:
    """The map that does the first and then the second; slopes are not negative."""
    out: Pieces = []

    def put(start: float, a: float, b: float) -> None:
        # neighbours that differ by rounding only are one piece
        if not out or out[-1][1] != a or abs(out[-1][2] - b) > 1e-12 * max(1.0, abs(b)):
            out.append((start, a, b))

    for k, (start, a, b) in enumerate(first):
        if a == 0:
            put(start, 0.0, value(second, b))
            continue
        end = first[k + 1][0] if k + 1 < len(first) else math.inf
        low = -math.inf if start == -math.inf else a * start + b
        for n, (at, c, d) in enumerate(second):
            if n + 1 < len(second) and second[n + 1][0] <= low:
                continue
            begin = start if at <= low else (at - b) / a
            if begin >= end:
                break
            put(max(begin, start), c * a, c * b + d)
    return out


@dataclass(frozen=True)
class Fold:
    """A fold and the maps that its steps are."""

    #: The state before a key's first row, and what a row makes of it: (state, *found).
    start: Callable[[], object]
    step: Callable[..., tuple]
    #: The numbers of a state, the map of each that a row is (given the row before), and a state from its numbers and the last row.
    numbers: Callable[[object], tuple]
    maps: Callable[[tuple, tuple], tuple[Pieces, ...]]
    state: Callable[[tuple, tuple], object]


def _runs(batches, key: str, reads: list[str]):
    """(batch, key, values) row by row."""
    for batch in batches:
        yield batch, zip(batch.column(key).to_pylist(), *(batch.column(c).to_pylist() for c in reads), strict=True)


def _chunk(batch) -> int:
    return batch.column(batch.num_columns - 1)[0].as_py()


def _beginnings(cut: DataFrame, chunk: str, key: str, reads: list[str], fold: Fold) -> dict[tuple[int, object], object]:
    """The state with which each part begins that goes on with the key of the part before."""
    ends = cut.groupBy(chunk).agg(F.first(key).alias("first"), F.last(key).alias("last")).orderBy(chunk).collect()
    split = {b["first"] for a, b in zip(ends, ends[1:], strict=False) if a["last"] == b["first"]}
    if not split:
        return {}
    schema = pa.schema([("chunk", pa.int32()), ("part", pa.binary())])

    def composed(batches):
        held: dict[object, list] = {}
        number = None
        for batch, rows in _runs(batches, key, reads):
            number = _chunk(batch) if batch.num_rows else number
            for k, *values in rows:
                if k not in split:
                    continue
                values = tuple(values)
                own = held.get(k)
                if own is None:
                    held[k] = [values, values, None]
                else:
                    moves = fold.maps(own[1], values)
                    own[1], own[2] = values, moves if own[2] is None else tuple(map(then, own[2], moves))
        for k, part in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([pickle.dumps((k, *part))], pa.binary())], schema=schema)

    sent = cut.select(key, *[c for c in reads if c != key], chunk).mapInArrow(composed, "chunk int, part binary").collect()
    parts = sorted(((r.chunk, *pickle.loads(r.part)) for r in sent), key=lambda p: p[0])
    states: dict[object, object] = {}
    found: dict[tuple[int, object], object] = {}
    for number, k, first, last, moves in parts:
        if k in states:
            found[number, k] = states[k]
        state = fold.step(states[k] if k in states else fold.start(), *first)[0]
        if moves is not None:
            state = fold.state(tuple(map(value, moves, fold.numbers(state))), last)
        states[k] = state
    return found


def scan_fold(rows: DataFrame, key: str, order: list[str], reads: list[str], fold: Fold, added: str) -> DataFrame:
    """All rows with what ``fold.step(state, *reads)`` finds for each in the order of its key: (state, *added); added: DDL of the new columns."""
    extra = StructType.fromDDL(added)
    names, new = rows.columns, extra.fieldNames()
    chunk = "part"
    while chunk in names:
        chunk += "_"
    cut = checkpointed(rows.repartitionByRange(F.col(key), *order).sortWithinPartitions(key, *order)).withColumn(chunk, F.spark_partition_id())
    begins = _beginnings(cut, chunk, key, reads, fold)
    schema = StructType(rows.schema.fields + extra.fields)
    kinds = [{"double": pa.float64(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[extra[n].dataType.simpleString()] for n in new]

    def folded(batches):
        key_now, state = object(), None
        for batch, values in _runs(batches, key, reads):
            number = _chunk(batch) if batch.num_rows else 0
            out: tuple[list, ...] = tuple([] for _ in new)
            for k, *read in values:
                if k != key_now:
                    key_now, state = k, begins[number, k] if (number, k) in begins else fold.start()
                state, *found = fold.step(state, *read)
                for column, one in zip(out, found, strict=True):
                    column.append(one)
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in range(len(names))] + [pa.array(c, kind) for c, kind in zip(out, kinds, strict=True)], names=[*names, *new])

    return cut.mapInArrow(folded, schema)
