"""Counts, packing and the token store, against the tokenizers library itself."""

import functools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fathomline.llm import packing, token_count, token_store
from fathomline.llm.unit_encoder import UnitEncoder

WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = [
    "", None, "don't stop.'s 'tis a' . '. 's'", "a <|endoftext|> b", "<|ENDOFTEXT|>", "tab\t\nx  \n y \x1c! \x1c\n  z　 q", "é Å ́x", "İSTANBUL ß Σας", "  lead", "trail  ", "\n\n\n", "1a2b 3.4,5 a1.",
    " \n b", "é  è\n\nç", "日本 語　です", "😀 x", "a\r\n b\x85 c", "x" * 5000, "word " * 3000,
]


OPEN = functools.cache(Tokenizer.from_file)


def library(path, text):
    return OPEN(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_units_give_the_librarys_ids(path):
    draw = random.Random(7)
    texts = ODD + ["".join(draw.choice("ab'.,1 \n\té \x1cÁ!<|日") for _ in range(draw.randint(1, 40))) for _ in range(1500)]
    enc = UnitEncoder(path, most_units=700)  # so small that the memo is cut down on the way
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for at in range(0, len(texts), 400):
        part = texts[at : at + 400]
        ids, ends = enc.encode(pa.array(part, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == want[at : at + 400]


def frame(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "clash", 5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, n_tokens int")


def test_counts(spark):
    got = {r.doc_id: r for r in token_count.count_tokens(frame(spark, ODD), WORD).collect()}
    for i, t in enumerate(ODD):
        n = len(library(WORD, t))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 2048)


def test_counts_of_nothing_and_of_repeats(spark):
    assert token_count.count_tokens(frame(spark, []), WORD).count() == 0
    assert token_count.count_tokens(frame(spark, ["a", "a"], [1, 1]), WORD).count() == 2


def check_pieces(pieces, texts, capacity):
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for i, t in enumerate(texts):
        ids = [*library(BYTE, t), 1]
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for held in by_sequence.values():
        at = 0
        for p in sorted(held, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity


def test_packing_loses_nothing(spark):
    texts = [*ODD, *("some words to fill windows " * k for k in range(1, 60))]
    check_pieces(packing.pack(frame(spark, texts).repartition(3, "doc_id"), BYTE, capacity=256, item_tokens=32, block_windows=8).collect(), texts, 256)


def test_packing_wastes_little(spark):
    texts = ["some words to fill windows " * (1 + k % 90) for k in range(1200)]
    pieces = packing.pack(frame(spark, texts).coalesce(1), BYTE).collect()
    held = sum(p.length for p in pieces)
    assert held / (2048 * len({p.sequence_id for p in pieces})) > 0.985


def test_tiny_documents_fill_windows_in_bounded_memory(spark):
    docs = spark.range(0, 600_000, 1, 1).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("")).alias("text"))
    pieces = packing.pack(docs, BYTE)
    r = pieces.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("held"), F.count_distinct("sequence_id").alias("windows"), F.count_distinct("doc_id").alias("docs")).first()
    assert r.n == r.held == r.docs == 600_000 and r.held / (2048 * r.windows) >= 0.99
    sums = pieces.groupBy("sequence_id").agg(F.sum("length").alias("held"), F.max(F.col("offset") + F.col("length")).alias("end"), F.count_distinct("offset").alias("n"))
    assert sums.where("held <> end OR n <> held OR held > 2048").isEmpty()


def test_a_full_block_of_tiny_pieces_is_small():
    import tracemalloc

    tracemalloc.start()
    block = packing._Block(2048, 256)
    for i in range(packing.BLOCK_PIECES):
        block.add((i, 1), 0, 1, b"\1\0\0\0")
    rest = block.split_off(256)
    columns = block.packed()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6 and len(columns[0]) + len(rest.pieces) == packing.BLOCK_PIECES and len(columns[0]) % 2044 == 0


@pytest.mark.parametrize(("capacity", "item_tokens", "block_pieces"), [(64, 63, 10), (16, 300, 3), (7, 2, 1), (2048, 256, 5)])
def test_packing_in_odd_shapes(spark, capacity, item_tokens, block_pieces):
    texts = [*ODD, *("a few words " * (k % 23) for k in range(80))]
    check_pieces(packing.pack(frame(spark, texts).coalesce(1), BYTE, capacity=capacity, item_tokens=item_tokens, block_windows=4, block_pieces=block_pieces).collect(), texts, capacity)


def test_packing_is_the_same_again_and_of_nothing_is_nothing(spark):
    docs = frame(spark, ODD).coalesce(1)
    assert sorted(packing.pack(docs, BYTE).collect()) == sorted(packing.pack(docs, BYTE).collect())
    assert packing.pack(frame(spark, []), BYTE).count() == 0


def test_window_count_rises_over_capacity():
    windows = packing.pack_block([7, 7, 7], 10)
    assert sorted(map(len, windows)) == [1, 1, 1]
    assert packing.pack_block([], 10) == []


def test_differencing_evens_out():
    draw = random.Random(3)
    sizes = [draw.randint(1, 100) for _ in range(400)]
    loads = [sum(sizes[i] for i in w) for w in packing.difference(sizes, 20)]
    assert sum(loads) == sum(sizes) and max(loads) - min(loads) <= 3


def test_store_round_trip(spark, tmp_path):
    texts = [*ODD, *(f"document number {i} says the same thing" for i in range(300))]
    ids = [((i * 37) % 1000) - 5 for i in range(len(texts))]
    docs = frame(spark, texts, ids)
    path = str(tmp_path / "store")
    manifest = token_store.write_store(docs, path, WORD, shard_bytes=4000)
    got = token_store.read_store(spark, path, manifest).orderBy("start").collect()
    at = 0
    for r, i in zip(got, sorted(range(len(ids)), key=lambda i: ids[i]), strict=True):
        want = np.array([*library(WORD, texts[i]), 1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (ids[i], at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)
    name = manifest.orderBy("part", "shard").first().file
    shard = token_store.Shard(path, name)
    first = min(ids)
    assert shard.find(first)[0].tolist() == [*library(WORD, texts[ids.index(first)]), 1]
    assert shard.find(10**9) == []


def test_store_keeps_repeated_rows_each(spark, tmp_path):
    path = str(tmp_path / "store")
    manifest = token_store.write_store(frame(spark, ["same text", "same text", "other", None], [4, 4, 4, 2]), path, WORD)
    got = token_store.read_store(spark, path, manifest).orderBy("start").collect()
    assert [r.doc_id for r in got] == [2, 4, 4, 4] and sorted(r.n_tokens for r in got) == sorted(len(library(WORD, t)) + 1 for t in ("same text", "same text", "other", None))


def test_store_refuses_another_dictionary(spark, tmp_path):
    path = str(tmp_path / "store")
    manifest = token_store.write_store(frame(spark, ["a b c"] * 3), path, WORD)
    (tmp_path / "store" / "dictionary.zdict").write_bytes(b"other")
    with pytest.raises(ValueError, match="another dictionary"):
        token_store.Shard(path, manifest.first().file)


def test_store_of_nothing(spark):
    assert token_store.store_digest(frame(spark, []), WORD).count() == 0
    assert token_store.store_digest(frame(spark, ["a"]).withColumn("doc_id", F.lit(None).cast("long")), WORD).first().doc_id is None
