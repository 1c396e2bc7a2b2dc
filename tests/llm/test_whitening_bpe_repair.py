"""Whitening, byte-level BPE and conversation repair, against brute force, the library and SQL."""

import base64
import hashlib
import heapq
import itertools
import random
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from fathomline.llm import byte_bpe, conversation_repair, queries, whitening
from oracle import connection, rows_of

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SF = "/root/testdata/sf0.001"


# whitening


def brute(rows, k=16):
    """(n, deviations, covariance, list of x) of one vector length by whole numbers."""
    x = [[int(np.floor(64 * np.float64(c))) + 1_000_000 for c in row] for row in rows]
    fit = [list(t) for t in {tuple(r) for r in x}]
    n, d = len(fit), len(x[0])
    sums = [sum(r[j] for r in fit) for j in range(d)]
    deviations = [sum((n * r[j] - sums[j]) ** 2 for j in range(d)) for r in x]
    cov = [[Fraction(n * sum(r[i] * r[j] for r in fit) - sums[i] * sums[j], n * n) for j in range(d)] for i in range(d)]
    return n, deviations, np.array([[float(c) for c in r] for r in cov]), x, [Fraction(s, n) for s in sums]


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, "clash", 7) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, component string, n int")


def test_whitening_equals_whole_numbers(spark):
    draw = np.random.default_rng(5)
    vectors = [[float(np.float32(c)) for c in draw.normal(0, 1 + np.arange(20) / 5)] for _ in range(300)]
    vectors += vectors[:40]  # repeats count once in the fit
    odd = [None, [None] + vectors[0][1:], [float("nan")] + vectors[0][1:], [float("inf")] + vectors[0][1:], []]
    got = whitening.whiten(frame(spark, vectors + odd)).collect()
    n, deviations, cov, x, mean = brute(vectors)
    values, axes = np.linalg.eigh(cov)
    by = {(r.vec_id, r.component): r for r in got}
    assert len(by) == len(got) == 340 * 16
    whole = np.array([[float(a - m) for a, m in zip(row, mean, strict=True)] for row in x])
    for c in range(1, 17):
        e, axis = values[-c], axes[:, -c]
        want, have = whole @ axis / np.sqrt(e), np.array([by[i, c].whitened for i in range(340)])
        assert min(np.abs(want - have).max(), np.abs(want + have).max()) < 1e-9
        assert all(by[i, c].n == n == 300 and by[i, c].deviation == deviations[i] and abs(by[i, c].explained - e / np.trace(cov)) < 1e-12 and by[i, c].identity_error < 1e-9 for i in range(340))


@pytest.mark.parametrize("scale", [1e-3, 3e4, 1e9, 1e16, 1e30])
def test_sums_and_products_are_exact_whatever_the_entries(spark, scale):
    draw = np.random.default_rng(6)
    vectors = [[float(np.float32(c)) for c in draw.normal(0, scale, 3)] for _ in range(50)]
    x = whitening.quantised(frame(spark, vectors), "vec_id", "embedding").select("x").repartition(5)
    n, sums, cross = whitening.scatter(x)[3]
    y = [[min(max(int(np.floor(64 * c)), -(1 << 62)), 1 << 62) for c in v] for v in vectors]
    assert n == 50 and sums == [sum(r[j] for r in y) for j in range(3)]
    assert all(cross.get((i, j), 0) == sum(r[i] * r[j] for r in y) for i in range(3) for j in range(i, 3))


def test_whitening_of_lengths_constants_and_nothing(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    alone = whitening.whiten(frame(spark, [[1.0, 2.0], [1.0, 2.0]])).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(alone)] == [(i, c, 1, 0, None, None, None) for i in (0, 1) for c in (1, 2)]
    # a constant dimension has no variance; another length has a fit of its own
    mixed = whitening.whiten(frame(spark, [[1.0, 5.0], [2.0, 5.0], [4.0, 5.0], [1.0], [3.0]])).collect()
    by = {(r.vec_id, r.component): r for r in mixed}
    assert sorted(by) == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (4, 1)]
    assert all(by[i, 2].whitened is None and by[i, 1].n == 3 and by[i, 1].explained == 1 for i in range(3)) and by[3, 1].n == 2
    assert sorted(round(by[i, 1].whitened, 9) for i in (3, 4)) == [-1, 1] and by[3, 1].identity_error < 1e-9


# byte-level BPE


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    "", None, "don't stop.'s 'tis a' . '. 's'", "a <|endoftext|> b", "tab\t\nx  \n y \x1c! \x1c\n  z　 q", "é Å ́x", "İSTANBUL", "  lead", "trail  ", "\n\n\n", " \n b", "日本 語　です", "😀 x", "a\r\n b\x85 c",
    "x" * 50_000, "word " * 3000, "ab" * 40_000, "1234567890" * 500, "\x00\x01", "=" * 301 + " " * 300,
]


def test_encoding_is_the_librarys_and_decodes_to_the_text(spark):
    draw = random.Random(7)
    texts = TEXTS + ["".join(draw.choice("ab'.,1 \n\té \x1cÁ!<|日") for _ in range(draw.randint(1, 40))) for _ in range(500)]
    docs = spark.createDataFrame([(i // 2 * 2, t, "clash", b"x") for i, t in enumerate(texts)], "doc_id long, text string, ids string, decoded binary").repartition(3)
    rows = byte_bpe.decode_ids(byte_bpe.encode_texts(docs, RANKS, batch_bytes=60_000), RANKS).collect()
    plain = library()
    want = sorted((i // 2 * 2, np.array(plain.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in enumerate(texts))
    assert sorted((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in rows) == want and all(r.n_tokens * 4 == len(r.ids) for r in rows)
    both = byte_bpe.encode_texts(docs, RANKS, decoded=True, batch_bytes=60_000).collect()
    assert sorted((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in both) == want
    assert byte_bpe.encode_texts(docs.limit(0), RANKS).count() == 0


def test_another_pattern_and_a_small_memo():
    pattern = r"\p{L}+|[^\p{L}]+"
    enc = byte_bpe.RankEncoder(RANKS, pattern, most_units=3)
    plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: r for r, t in enumerate(enc.tokens)}, special_tokens={})
    for _ in range(2):
        for text in TEXTS:
            ids, _ = enc.encode(pa.array([text], pa.string()))
            assert ids.tolist() == plain.encode_ordinary(text or "")


def test_the_hash_is_perfect_and_minimal():
    for keys in [byte_bpe.read_ranks(RANKS), [b"a"], [b"a", b"b", b"", b"a" * 99], []]:
        found = byte_bpe.PerfectHash(keys)
        assert found.find(keys).tolist() == list(range(len(keys))) and sorted(found.item.tolist()) == (list(range(len(keys))) or [-1])
        assert (found.find([b"no such token " * 9, b"\xff\xfe\xfd"]) == -1).all()


def test_bad_ids_are_refused(spark):
    for ids in (b"\xff\xff\xff\xff", b"abc"):
        with pytest.raises(Exception, match="no token|32-bit"):
            byte_bpe.decode_ids(spark.createDataFrame([(1, ids)], "doc_id long, ids binary"), RANKS).collect()


def test_a_long_run_without_tokens_takes_seconds():
    import time

    enc, began = byte_bpe.RankEncoder(RANKS, public_tokenizers.PATTERN), time.time()
    run = "".join(random.Random(1).choice("qxzj") for _ in range(300_000))
    ids, _ = enc.encode(pa.array([run]))
    assert enc.decode(ids)[0].tobytes() == run.encode() and time.time() - began < 20


# conversation repair


def cheapest(signature):
    """Cost and least audit over all edits, by a search from the start over (cost, audit)."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, roles = heapq.heappop(heap)
        ends = roles[-3:] if len(roles) < 4 else roles[-2:]
        if (at, ends) in seen:
            continue
        seen.add((at, ends))
        if at == len(signature) and (not roles or (roles[-1] == "a" and roles.lstrip("s") != "")):
            return cost, audit
        nexts = "su" if not roles else "a" if roles[-1] == "u" else "u"
        if at < len(signature):
            row = signature[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, roles))
            if row != "-":
                late = 3 * row.isupper()
                if row.lower() in nexts and row.lower() != "x":
                    heapq.heappush(heap, (cost + late, audit + "K", at + 1, roles + row.lower()))
                heapq.heappush(heap, (cost + late + 3, audit + "R", at + 1, roles + nexts[-1]))
        if len(audit) < 2 * len(signature) + 4:
            heapq.heappush(heap, (cost + 3, audit + "I", at, roles + nexts[-1]))


def test_every_short_signature_is_solved_at_the_least_cost():
    for size in range(5):
        for signature in map("".join, itertools.product("suaxUS-", repeat=size)):
            assert conversation_repair.solve(signature) == cheapest(signature), signature
    draw = random.Random(4)
    for _ in range(300):
        signature = "".join(draw.choice("suaxSUAX-ua") for _ in range(draw.randint(5, 14)))
        assert conversation_repair.solve(signature) == cheapest(signature), signature


def test_a_long_signature_is_solved_without_deep_recursion():
    cost, audit = conversation_repair.solve("ua" * 100_000 + "u" + "-" * 1000)
    assert cost == 4003 and audit == "K" * 200_001 + "D" * 1000 + "I"


def replayed(rows, audit):
    out, rows = [], list(rows)
    system = bool(rows) and audit[:1] == "K" and rows[0][0][:1] == "s"
    for edit in audit:
        expected = ("user", "assistant")[(len(out) - system) % 2]
        role, text = rows.pop(0) if edit != "I" else (None, "")
        if edit != "D":
            out.append(f"{role if edit == 'K' else expected}:{text}")
    return hashlib.sha256("\n".join(out).encode()).hexdigest()


def test_repair_of_odd_rows(spark):
    rows = [
        (1, 0, "user", "Hello."), (1, 1, "assistant", "Hi!"),
        (2, 5, "user", "a."), (2, 5, "user", "a."), (2, None, "system", "s."), (2, 9, "assistant", " \t\n"), (2, 9, "tool", "cut off"), (2, 7, "assistant", "end.  "),
        (None, None, None, None), (None, None, "user", "x?"),
        (3, 1, "assistant", " "), (4, 1, "system", "only."), (5, 2, "usher", "Keeps its role."), (5, 3, "admin", "and its text"),
    ]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, audit string").repartition(4)
    got = {r.conv_id: r for r in conversation_repair.repair(conversation_repair.plain(turns)).collect()}
    digits = lambda c: (got[c].gaps, got[c].blank, got[c].duplicate, got[c].truncated, got[c].illegal, got[c].cost, got[c].audit)
    assert set(got) == {1, 2, None, 3, 4, 5}
    assert digits(1) == (0, 0, 0, 0, 0, 0, "KK")
    ordered = [("system", "s."), ("user", "a."), ("user", "a."), ("assistant", "end.  "), ("assistant", " \t\n"), ("tool", "cut off")]
    assert digits(2) == (2, 1, 1, 1, 3, 12, "KKDKDD") and got[2].repaired_sha256 == replayed(ordered, "KKDKDD")
    assert digits(None) == (0, 1, 0, 0, 1, 7, "DKI") and got[None].repaired_sha256 == hashlib.sha256(b"user:x?\nassistant:").hexdigest()
    assert digits(3) == (0, 1, 0, 0, 0, 4, "D") and got[3].repaired_sha256 == hashlib.sha256(b"").hexdigest()
    assert digits(4) == (0, 0, 0, 0, 0, 4, "D")
    assert digits(5) == (0, 0, 0, 1, 0, 3, "KK") and got[5].repaired_sha256 == hashlib.sha256(b"usher:Keeps its role.\nadmin:and its text").hexdigest()
    assert conversation_repair.repair(conversation_repair.plain(turns.limit(0))).count() == 0


def test_one_conversation_of_many_rows_and_one_common_signature(spark):
    long = spark.range(30_000).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), "id", F.lit(".")).alias("text"))
    short = spark.range(4000).select((F.col("id") / 2).cast("long").alias("conv_id"), (F.col("id") % 2).alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("same.").alias("text"))
    got = conversation_repair.repair(conversation_repair.plain(long.union(short))).collect()
    whole = "\n".join(f"{('user', 'assistant')[i % 2]}:t{i}." for i in range(30_000))
    assert len(got) == 2001 and {(r.audit, r.cost) for r in got if r.conv_id >= 0} == {("KK", 0)}
    assert [(len(r.audit), r.cost, r.repaired_sha256) for r in got if r.conv_id < 0] == [(30_000, 0, hashlib.sha256(whole.encode()).hexdigest())]


def test_repair_without_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(conversation_repair, "SHIP_BYTES", -1)
    turns = spark.createDataFrame([(i, 0, "user", "a.") for i in range(9)], "conv_id long, turn long, role string, text string")
    assert sorted((r.conv_id, r.audit) for r in conversation_repair.repair(conversation_repair.plain(turns)).collect()) == [(i, "KI") for i in range(9)]


def test_repair_equals_its_sql(spark):
    con = connection(SF)
    result = con.execute(queries.ORACLE_SQL["op13_conversation_repair"])
    got = queries.op13_conversation_repair(spark, SF)
    columns = [d[0] for d in result.description]
    assert rows_of(got.columns, got.collect()) == rows_of(columns, result.fetchall())


def test_queries_read_whole_tables(spark):
    white = queries.op11_whitening(spark, SF)
    assert dict(white.dtypes)["deviation"] == "bigint" and white.count() == 16 * spark.read.parquet(f"{SF}/embeddings.parquet").count()
    bpe = {r.doc_id: r for r in queries.op12_byte_bpe(spark, SF).collect()}
    plain = library()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = np.array(plain.encode_ordinary(r.text or ""), "<u4")
        assert (bpe[r.doc_id].n_tokens, bpe[r.doc_id].ids_sha256, bpe[r.doc_id].decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
