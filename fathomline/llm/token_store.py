"""Token ids in binary shard files: one zstandard frame a document, one dictionary for all.

File, little-endian: ``FIDS1`` and a NUL, id width in bytes (u2), 16 bytes of the dictionary's hash,
the frames, then the index (doc_id i8, offset i8 of the frame, frame bytes i8, tokens i8 a document,
in file order), then documents (i8), index offset (i8). The dictionary lies beside the shards in
``dictionary.zdict``; a reader refuses a shard whose hash differs. A short document is read by its
index entry alone: one seek, one small frame.

Documents are range-partitioned and sorted by id (ties: by text), encoded after the exchange, and each
partition writes its shards under a name of its own and moves them into place, so a retried or
speculative task leaves the same files. The driver sees one short row a shard.

Null or empty text: the end id alone. Null ids come first. Repeated rows are stored each; an empty
table gives no shards and an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, fresh_path, output
from .unit_encoder import encoder

MAGIC = b"FIDS1\0"
NO_ID = -(1 << 63)
BATCH_BYTES = 8_000_000
#: Bounds of the dictionary and of the sample of documents it is trained on.
DICTIONARY_BYTES, SAMPLE_DOCS, SAMPLE_DOC_BYTES = 64 << 10, 2000, 32 << 10
SHARD_BYTES = 64 << 20


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, sample_docs: int = SAMPLE_DOCS, dictionary_bytes: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary from a bounded sample (about sample_docs documents of at most SAMPLE_DOC_BYTES each, by hash of id and text); b"" if there is too little to train on."""
    import zstandard

    rows = docs.count()
    keep = min(1.0, 4.0 * sample_docs / max(rows, 1))
    chance = F.pmod(F.xxhash64("key", "text"), F.lit(1 << 30)) < int(keep * (1 << 30))
    texts = [r.text for r in docs.where(chance & (F.octet_length("text") <= SAMPLE_DOC_BYTES)).select("text").limit(sample_docs).collect()]
    if not texts:
        return b""
    enc = encoder(tokenizer)
    ids, ends = enc.encode(pa.array(texts, pa.string()))
    end = np.array([end_id], enc.dtype).tobytes()
    samples = [ids[a:b].tobytes() + end for a, b in zip(ends[:-1], ends[1:], strict=True)]
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(dictionary_bytes, max(total // 8, 256)), samples).as_bytes()
    except zstandard.ZstdError:  # too few or too uniform samples: frames then stand without a dictionary
        return b""


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", level: int = 3, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the store to the shared folder ``path``; returns its manifest (part, shard, file, docs, tokens), a row a shard in id order."""
    import zstandard

    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("key"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    dictionary = train_dictionary(rows, tokenizer, end_id)
    digest = hashlib.sha256(dictionary).digest()[:16]
    files, root = _fs(path)
    files.create_dir(root, recursive=True)
    with files.open_output_stream(f"{root}/dictionary.zdict") as out:
        out.write(dictionary)
    schema = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])

    def shards(batches):
        import uuid

        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        files, root = _fs(path)
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        press = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True, write_checksum=True)
        head = MAGIC + struct.pack("<H", enc.dtype.itemsize) + digest
        shard, out, index, at, temporary = 0, None, [], 0, ""

        def close():
            nonlocal out, shard
            out.write(np.array(index, "<i8").tobytes())
            out.write(struct.pack("<qq", len(index), at))
            out.close()
            name = f"part-{part:06d}-{shard:04d}.fids"
            files.move(temporary, f"{root}/{name}")
            found = output(schema, [[part], [shard], [name], [len(index)], [sum(x[3] for x in index)]])
            out, shard = None, shard + 1
            return found

        for batch in by_bytes(batches, "text", BATCH_BYTES):
            ids, ends = enc.encode(batch.column("text"))
            data, width, ends = memoryview(ids.tobytes()), enc.dtype.itemsize, ends.tolist()
            for n, key in enumerate(batch.column("key").to_pylist()):
                if out is None:
                    temporary = f"{root}/.{uuid.uuid4().hex}"
                    out, index, at = files.open_output_stream(temporary), [], len(head)
                    out.write(head)
                frame = press.compress(bytes(data[ends[n] * width : ends[n + 1] * width]) + end)
                out.write(frame)
                index.append((NO_ID if key is None else key, at, len(frame), ends[n + 1] - ends[n] + 1))
                at += len(frame)
                if at >= shard_bytes:
                    yield close()
        if out is not None:
            yield close()

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # the tie-breaker keeps repeated ids, even whole repeated rows, from piling up in one range
    salted = rows.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    ordered = salted.repartitionByRange(parts, F.col("key").asc_nulls_first(), "tie", "row").sortWithinPartitions(F.col("key").asc_nulls_first(), "tie", "row").select("key", "text")
    manifest = ordered.mapInArrow(shards, "part long, shard long, file string, docs long, tokens long").collect()
    return spark.createDataFrame(sorted(manifest), "part long, shard long, file string, docs long, tokens long")


class Shard:
    """One open shard file. index: (doc_id, offset, frame bytes, tokens) rows."""

    def __init__(self, path: str, name: str):
        import zstandard

        files, root = _fs(path)
        with files.open_input_file(f"{root}/dictionary.zdict") as file:
            dictionary = file.read()
        self.file = files.open_input_file(f"{root}/{name}")
        head = self.file.read(len(MAGIC) + 18)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{name} is not a shard of token ids")
        if head[-16:] != hashlib.sha256(dictionary).digest()[:16]:
            raise ValueError(f"{name} was written with another dictionary")
        self.dtype = np.dtype(f"<u{struct.unpack('<H', head[len(MAGIC) : -16])[0]}")
        size = self.file.size()
        self.file.seek(size - 16)
        n, at = struct.unpack("<qq", self.file.read(16))
        self.file.seek(at)
        self.index = np.frombuffer(self.file.read(32 * n), "<i8").reshape(n, 4)
        self.open = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def ids(self, row: int) -> np.ndarray:
        _, at, size, _ = self.index[row].tolist()
        self.file.seek(at)
        return np.frombuffer(self.open.decompress(self.file.read(size)), self.dtype)

    def find(self, doc_id: int) -> list[np.ndarray]:
        """Ids of each document of that id: a binary search in the index, then one frame each."""
        keys = self.index[:, 0]
        return [self.ids(i) for i in range(int(np.searchsorted(keys, doc_id)), int(np.searchsorted(keys, doc_id, "right")))]


def read_store(spark: SparkSession, path: str, manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every stored document, read back from the files."""
    schema = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    before, rows = 0, []
    for r in manifest.orderBy("part", "shard").collect():
        rows.append((r.file, before))
        before += r.tokens
    starts = spark.createDataFrame(rows, "file string, before long").repartition(max(1, min(len(rows), 2000)), "file")

    def documents(batches):
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist(), strict=True):
                shard = Shard(path, name)
                found = []
                for row in range(len(shard.index)):
                    ids = shard.ids(row)
                    key = int(shard.index[row, 0])
                    found.append((None if key == NO_ID else key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(found) == 20_000:
                        yield output(schema, [list(c) for c in zip(*found, strict=True)])
                        found = []
                if found:
                    yield output(schema, [list(c) for c in zip(*found, strict=True)])

    return starts.mapInArrow(documents, "key long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("key", id_col)


def store_digest(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Writes a store into the shared folder and reads it back."""
    path = fresh_path(docs.sparkSession, "token-store")
    return read_store(docs.sparkSession, path, write_store(docs, path, tokenizer, end_id))
