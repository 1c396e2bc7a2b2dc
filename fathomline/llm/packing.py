"""Packing of token ids into fixed windows by Karmarkar-Karp multiway differencing.

Documents are encoded as they stream through a task, and cut into pieces: whole windows first, then
pieces of at most ``item_tokens``. Neighbouring pieces of fewer than ``LEAST_ITEM`` tokens are joined into
one item. A block takes pieces until it holds ``block_windows`` windows less a small slack, or
``block_pieces`` pieces; what then stands over the last full window goes on in the next block (a document
at the border is cut there). So a block's pieces, items and loads are bounded whatever the documents'
sizes, and no rows are shuffled. Within a block the items start as partial partitions of one item each;
the two with the largest imbalance are merged, largest loads against smallest, until one partition with
near-equal windows is left. If its fullest window exceeds the capacity, the block is packed again with
one more window.

A retried task deals the same rows to the same blocks, so sequence ids (partition number, then count)
and pieces come out as before. Null or empty text: the end id alone. Repeated rows are packed each on
their own; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_bytes, give_back, output
from .unit_encoder import encoder

BATCH_BYTES = 4_000_000
#: Windows and pieces of a block, a piece's largest and an item's smallest size, and tokens a window that a block leaves free for the differences' remains.
BLOCK_WINDOWS, BLOCK_PIECES, ITEM_TOKENS, LEAST_ITEM, SLACK_TOKENS = 256, 65_536, 256, 64, 4


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Items dealt to windows by largest differencing; each window lists the numbers of its items."""
    if not sizes:
        return [[] for _ in range(windows)]
    loads, heap = [], []
    for i, size in enumerate(sizes):
        alone = np.zeros(windows, np.int64)
        alone[-1] = size  # loads stand in ascending order
        loads.append(alone)
        heap.append((-size, i))
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = loads[a] + loads[b][::-1]
        loads[a] = loads[b] = None
        order = np.argsort(both, kind="stable")
        both = both[order]
        merges.append((a, b, order))
        heapq.heappush(heap, (-int(both[-1] - both[0]), len(loads)))
        loads.append(both)
    # from the last merge back to the single items: the final window of each load
    final = {heap[0][1]: np.arange(windows)}
    for number in range(len(merges) - 1, -1, -1):
        a, b, order = merges[number]
        mine = final.pop(len(sizes) + number)
        window = np.empty(windows, np.int64)
        window[order] = mine
        final[a], final[b] = window, window[::-1]
    dealt: list[list[int]] = [[] for _ in range(windows)]
    for i in range(len(sizes)):
        dealt[int(final[i][-1])].append(i)
    return dealt


def pack_block(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of at most the capacity; one more whenever the fullest is over it."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        dealt = difference(sizes, windows)
        if max(sum(sizes[i] for i in w) for w in dealt) <= capacity:
            return [w for w in dealt if w]
        windows += 1


class _Block:
    """Pieces of one block, as (document number, start, length, ids)."""

    def __init__(self, capacity: int, block_windows: int):
        self.capacity, self.fill = capacity, capacity - (SLACK_TOKENS if capacity >= 64 else 0)
        self.room = block_windows * self.fill
        self.pieces: list[tuple[int, int, int, bytes]] = []
        self.docs: list[tuple[int | None, int]] = []

    def add(self, doc: tuple[int | None, int], start: int, length: int, ids: bytes) -> None:
        if not self.docs or self.docs[-1] is not doc:
            self.docs.append(doc)
        self.pieces.append((len(self.docs) - 1, start, length, ids))
        self.room -= length

    def split_off(self, block_windows: int) -> "_Block":
        """The block that goes on with what stands over the last full window."""
        rest = _Block(self.capacity, block_windows)
        held = sum(p[2] for p in self.pieces)
        over = held % self.fill if held >= self.fill else 0
        moved = []
        while over:
            doc, start, length, ids = self.pieces.pop()
            part = min(over, length)
            moved.append((self.docs[doc], start + length - part, part, ids[4 * (length - part) :]))
            if part < length:
                self.pieces.append((doc, start, length - part, ids[: 4 * (length - part)]))
            over -= part
        for piece in reversed(moved):
            rest.add(*piece)
        return rest

    def items(self) -> list[list[int]]:
        """Numbers of the pieces of each item."""
        found, size = [], self.capacity
        for i, piece in enumerate(self.pieces):
            if size >= min(LEAST_ITEM, self.capacity // 8) or size + piece[2] > self.capacity // 2:
                found.append([])
                size = 0
            found[-1].append(i)
            size += piece[2]
        return found

    def packed(self) -> list[np.ndarray | list]:
        """Columns doc, start, length, crc, doc_tokens, window, offset."""
        items = self.items()
        rows: tuple[list, ...] = ([], [], [], [], [], [], [])
        for window, dealt in enumerate(pack_block([sum(self.pieces[i][2] for i in item) for item in items], self.capacity)):
            at = sorted(i for item in dealt for i in items[item])  # pieces stand in the order of their documents
            offset, k = 0, 0
            while k < len(at):  # neighbours of one document become one piece
                doc, start, length, ids = self.pieces[at[k]]
                k += 1
                parts = [ids]
                while k < len(at) and self.pieces[at[k]][:2] == (doc, start + length):
                    length += self.pieces[at[k]][2]
                    parts.append(self.pieces[at[k]][3])
                    k += 1
                for column, value in zip(rows, (*self.docs[doc][:1], start, length, zlib.crc32(b"".join(parts)), self.docs[doc][1], window, offset), strict=True):
                    column.append(value)
                offset += length
        return list(rows)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", item_tokens: int = ITEM_TOKENS, block_windows: int = BLOCK_WINDOWS, block_pieces: int = BLOCK_PIECES, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Pieces (id, start, length, ids_crc32, doc_tokens, sequence_id, offset); tokenizer: path of a tokenizers file on every worker."""
    schema = pa.schema([("key", pa.int64()), *((n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))])

    def pieces(batches):
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 40
        block = _Block(capacity, block_windows)

        def flush(last: bool):
            nonlocal sequence, block
            full, block = block, _Block(capacity, block_windows)
            if not last:
                block = full.split_off(block_windows)
            columns = full.packed()
            if columns[0]:
                windows = np.asarray(columns[5])
                columns[5] = windows + sequence
                sequence += int(windows.max()) + 1
                yield output(schema, columns)

        whole: list[tuple] = []  # windows that one document fills
        for batch in by_bytes(batches, "text", batch_bytes):
            ids, ends = encoder(tokenizer).encode(batch.column("text"))
            ids, ends = ids.astype("<u4"), ends.tolist()
            end = np.array([end_id], "<u4").tobytes()
            for n, key in enumerate(batch.column("key").to_pylist()):
                data = memoryview(ids[ends[n] : ends[n + 1]].tobytes() + end)
                total, start = len(data) // 4, 0
                while total - start >= capacity:
                    whole.append((key, start, capacity, zlib.crc32(data[4 * start : 4 * (start + capacity)]), total, sequence, 0))
                    sequence += 1
                    start += capacity
                doc = (key, total)
                while start < total:
                    length = min(item_tokens, total - start, block.room)
                    block.add(doc, start, length, bytes(data[4 * start : 4 * (start + length)]))
                    start += length
                    if not block.room or len(block.pieces) >= block_pieces:
                        yield from flush(last=False)
            if whole:
                yield output(schema, [list(c) for c in zip(*whole, strict=True)])
                whole = []
        yield from flush(last=True)
        give_back()

    rows = docs.select(docs[id_col].cast("long").alias("key"), docs[text_col].cast("string").alias("text"))
    out = rows.mapInArrow(pieces, "key long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("key", id_col)
