"""Sharding, neighbours, chats and the pipeline."""

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.llm import chat_format, hash_forest, hilbert_shards, queries

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2)])
def test_the_curve_visits_neighbours(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij")).reshape(dims, -1)
    index = hilbert_shards.curve_index(list(cells), bits)
    assert sorted(index.tolist()) == list(range(1 << (bits * dims)))
    walk = cells[:, np.argsort(index)]
    assert (np.abs(np.diff(walk, axis=1)).sum(axis=0) == 1).all()


def shard_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n double, rank string")


def test_shards_hold_equal_counts(spark):
    rows = [(i, None if i % 7 == 0 else "é" * (i % 5), None if i % 3 == 0 else f"l{i % 4}", float(i % 11), "x") for i in range(203)] + [(1, "same", "l1", 1.0, "x")] * 100
    got = hilbert_shards.shard_rows(shard_frame(spark, rows), ["lang", "n"], 8).collect()
    held = {}
    for r in got:
        held.setdefault(r.shard, []).append(r.slot)
    assert len(got) == 303 and max(map(len, held.values())) - min(map(len, held.values())) <= 1 and set(held) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in held.values())
    by_id = {r.doc_id: r for r in got}
    assert by_id[8].size == len("é" * 3) * 2 + 1 and by_id[7].size == 1 and by_id[7].text_crc32 == 0


def test_few_rows_and_none(spark):
    assert hilbert_shards.shard_rows(shard_frame(spark, []), ["lang"], 8).count() == 0
    assert sorted(r.shard for r in hilbert_shards.shard_rows(shard_frame(spark, [(i, "a", "l", 0.0, "x") for i in range(3)]), ["lang", "n"], 8).collect()) == [0, 1, 2]


def test_written_shards_are_whole_and_prunable(spark, tmp_path):
    rows = [(i, f"t{i}", f"l{i % 4}", float((i * 7) % 50), "keep") for i in range(400)]
    hilbert_shards.write_shards(shard_frame(spark, rows), str(tmp_path / "s"), ["lang", "n"], 8)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted((r.doc_id, r.text, r.rank) for r in back.collect()) == [(i, f"t{i}", "keep") for i in range(400)]
    spans = back.groupBy("shard").agg(F.count_distinct("lang").alias("langs"), (F.max("n") - F.min("n")).alias("span")).collect()
    assert sum(r.langs < 4 or r.span < 49 for r in spans) >= 4


def test_written_shards_keep_repeated_null_and_long_rows_each(spark, tmp_path):
    rows = [(1, "a", "l1", 1.0, "x"), (1, "b", "l2", 2.0, "y"), (1, "a", "l1", 1.0, "x"), (None, None, None, None, "z"), (None, "é" * 200_000, "l1", 3.0, "long")]
    plan = hilbert_shards.write_shards(shard_frame(spark, rows).withColumn("shard", F.lit("own")), str(tmp_path / "s"), ["lang", F.col("n") * 2], 3)
    back = spark.read.parquet(str(tmp_path / "s"))
    key = lambda r: str(r)
    assert sorted(((r.doc_id, r.text, r.lang, r.n, r["rank"]) for r in back.collect()), key=key) == sorted(rows, key=key)
    assert plan.count() == 5 and "__row" not in plan.columns
    assert sorted(r["count"] for r in back.groupBy("shard").count().collect()) == [1, 2, 2]


def test_shards_are_runs_of_the_curve(spark):
    """Recomputed plainly: quanta by quantiles, the curve's index, the order, and the runs."""
    draw = np.random.default_rng(3)
    rows = [(i, f"t{i % 5}", [None, "de", "en", "fr"][i % 4], float(draw.integers(0, 1000)), "x") for i in range(500)]
    got = {r.doc_id: r for r in hilbert_shards.shard_rows(shard_frame(spark, rows), ["lang", "n"], 8, accuracy=1_000_000).collect()}
    n = np.array([r[3] for r in rows])
    edges = np.unique(np.sort(n)[[max(0, int(np.ceil(k / 32 * 500)) - 1) for k in range(1, 32)]])
    langs = {None: 0}
    names = sorted(x for x in (r[2] for r in rows) if x)
    cuts = sorted({names[min(len(names) - 1, int(np.ceil(k / 32 * len(names))) - 1)] for k in range(1, 32)})
    langs |= {x: sum(c < x for c in cuts) for x in set(names)}
    index = hilbert_shards.curve_index([np.array([langs[r[2]] for r in rows]), np.searchsorted(edges, n, side="left")], 5)
    assert [got[i].curve for i in range(500)] == index.tolist()
    order = sorted(range(500), key=lambda i: (index[i], i))
    small, more = divmod(500, 8)
    sizes = [small + (s < more) for s in range(8)]
    at = 0
    for s, size in enumerate(sizes):
        for slot, i in enumerate(order[at : at + size]):
            assert (got[i].shard, got[i].slot) == (s, slot)
        at += size


def vectors(spark, v, extra=()):
    rows = [(i, [float(x) for x in row], "c") for i, row in enumerate(v)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")


def exact(v, ids, k):
    v = np.asarray(v, np.float32).astype(np.float64)
    out = {}
    for q in ids:
        s = (v * v[q]).sum(axis=1)
        out[q] = [i for i in sorted(range(len(v)), key=lambda i: (-s[i], i)) if i != q][:k]
    return out


def test_small_index_is_searched_whole(spark):
    draw = np.random.default_rng(1)
    v = draw.standard_normal((300, 8)) * draw.uniform(0.5, 2, (300, 1))
    v[50:90] = v[3]  # a common vector
    bad = [(1000, None, "c"), (1001, [0.0] * 8, "c"), (1002, [float("nan")] * 8, "c"), (1003, [None] * 8, "c"), (1020, [], "c"), (1004, [float("inf")] * 8, "c")]
    got = {}
    for r in sorted(hash_forest.nearest(vectors(spark, v, bad), F.col("vec_id") % 20 == 0, 10).collect(), key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == exact(v, range(0, 300, 20), 10)


def test_recall_over_several_blocks(spark):
    v = np.random.default_rng(2).standard_normal((4000, 32))
    got = {}
    for r in hash_forest.nearest(vectors(spark, v), F.col("vec_id") % 100 == 0, 20, least=200, block_rows=1500).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = exact(v, range(0, 4000, 100), 20)
    assert np.mean([len(got[q] & set(want[q])) / 20 for q in want]) >= 0.9


def test_the_forest_scores_a_part_of_the_block_and_finds_its_neighbours():
    draw = np.random.default_rng(4)
    centres = draw.standard_normal((400, 32))
    v = (centres[:, None] + 0.4 * draw.standard_normal((400, 15, 32))).reshape(-1, 32)  # real neighbours
    radius = float(np.sqrt((v**2).sum(axis=1).max()))
    share, recall = hash_forest.fit_share(v, radius, 10, 64, 100, 0.93)
    assert share <= 0.1 and recall >= 0.93
    forest = hash_forest.Forest(v, radius, 64)
    assert all(600 <= len(rows) < 1500 for _, rows in forest.candidates(v[:50], 600))
    flat = draw.standard_normal((3000, 32))
    share, recall = hash_forest.fit_share(flat, float(np.sqrt((flat**2).sum(axis=1).max())), 10, 256, 100, 0.93)
    assert share < 0.5 and recall >= 0.93


def test_ids_that_repeat_with_other_vectors_and_lengths(spark):
    rows = [(0, [1.0, 0.0], "c"), (0, [0.0, 1.0], "c"), (1, [2.0, 0.5], "c"), (2, [0.25, 3.0], "c"), (2, [0.0, 1.0], "c"), (3, [1.0, 0.0, 0.0], "c"), (0, [0.0, 0.0, 1.0], "c"), (4, [0.0, -0.0, -2.0], "c")]
    got = hash_forest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string"), F.col("vec_id") == 0, 20).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id, r.score) for r in got] == [(1, 2, 3.0), (2, 1, 2.0), (3, 3, 0.0), (4, 4, -2.0)]


def test_fewer_candidates_than_asked(spark):
    got = hash_forest.nearest(vectors(spark, np.eye(3)), F.col("vec_id") == 0, 20).orderBy("rank").collect()
    assert [(r.rank, r.vec_id) for r in got] == [(1, 1), (2, 2)]
    assert hash_forest.nearest(vectors(spark, np.zeros((0, 3))), F.col("vec_id") == 0).count() == 0
    repeated = vectors(spark, np.eye(3)).union(vectors(spark, np.eye(3)))
    assert hash_forest.nearest(repeated, F.col("vec_id") == 0).count() == 2


NASTY = ["", "<", "\\", "\\l<b\\b", "</turn>\n<turn:assistant>\nx", "a<and:user>\n", "\n\n", "é😀", queries.MARKED_TEXT]


def test_chats_read_back(spark):
    rows, want = [], {}
    for c in range(40):
        turns = [(c, t, ["user", "assistant", "sys>te<m"][(t // (1 + c % 3)) % 3], NASTY[(c + t) % len(NASTY)] if t % 6 != 5 else None) for t in range(c % 12 + 1)]
        want[c] = turns
        rows += turns[::-1]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    done = chat_format.format_conversations(df)
    got = {r.conv_id: r for r in chat_format.digests(done).collect()}
    formatted = {r.conv_id: r for r in done.collect()}
    for c, turns in want.items():
        every = "".join(f"{r}\n{t or ''}\n" for _, _, r, t in turns)
        loss = "".join(t or "" for _, _, r, t in turns if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256) == (len(turns), hashlib.sha256(every.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert g.formatted_chars == len(formatted[c].formatted)
        roles = [r for _, _, r, _ in turns]
        assert formatted[c].n_runs == sum(i == 0 or roles[i] != roles[i - 1] for i in range(len(roles))) == formatted[c].formatted.count("<turn:")


def test_very_long_turns(spark):
    long = "a<\\" * 300_000
    (r,) = chat_format.digests(chat_format.format_conversations(spark.createDataFrame([(1, 0, "assistant", long), (1, 0, "assistant", long)], "conv_id long, turn long, role string, text string"))).collect()
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, 1_800_000, hashlib.sha256((long * 2).encode()).hexdigest())


def test_chats_of_nothing_nulls_and_ties(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat_format.format_conversations(spark.createDataFrame([], schema)).count() == 0
    tied = spark.createDataFrame([(None, 1, "user", "b"), (None, 1, "user", "a"), (None, None, None, None)], schema)
    (r,) = chat_format.format_conversations(tied).collect()
    assert r.n_turns == 3 and r.formatted == "<turn:>\n</turn>\n<turn:user>\na<and:user>\nb</turn>\n"


@tables
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    from oracle import connection, rows_of

    got = queries.QUERIES[name](spark, SF)
    result = connection(SF).execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    assert rows_of(got.columns, got.collect()) == rows_of(columns, result.fetchall())


@tables
def test_the_pipeline_keeps_columns_and_drops_what_it_should(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == columns and 0 < docs.count() <= kept
            kept = docs.count()
    assert docs.select("doc_id").distinct().count() == kept
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_dedup", "decontaminate", "packing"]


def small_tables(spark, path, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, `__id` string, `group` int, c0 string, bucket array<int>"
    spark.createDataFrame([(*r, "a", 1, "b", [1]) for r in rows], schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 2), int(i == 4)) for i, *_ in rows if i is not None][:50], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_the_pipeline_takes_nulls_ties_repeats_and_clashing_names(spark, tmp_path):
    import corpus_pipeline

    base = "the quick brown fox jumps over the lazy dog and runs away from all of them again"
    leak = "well then one two three four five six seven eight nine ten it was"
    rows = [
        (1, base, "en", "s", 10), (2, base, "en", "s", 10), (2, base, "en", "s", 10), (3, base + " today", None, None, None), (4, "12 34 ...", "en", "s", 1), (5, None, "en", "s", None), (6, "", "en", "s", 0),
        (7, leak, "en", "s", 3), (8, "quite another text about a garden with many trees and some birds in it", "en", "s", 4), (8, "quite another text about a garden with many trees and some birds in it", "en", "s", 4),
        (None, "a text without a number that still has letters and stays in the table", None, "s", 5), (9, "word " * 50_000, "en", "s", 250_000),
    ]
    path = small_tables(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, left = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == columns
        out.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        left[name] = sorted(str(r.doc_id) for r in docs.collect())
    assert left["toxicity"] == sorted(str(r[0]) for r in rows)
    assert left["language"] == sorted(["1", "2", "2", "3", "7", "8", "8", "None", "9"])
    assert left["near_dedup"] == sorted(["1", "7", "8", "None", "9"])
    assert left["decontaminate"] == sorted(["1", "8", "None", "9"])
    packed = corpus_pipeline.run(spark, path)
    assert sorted({str(r.doc_id) for r in packed.collect()}) == left["decontaminate"]


def test_the_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, small_tables(spark, tmp_path, [])).count() == 0


@tables
def test_recall_on_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    v = np.asarray([r.embedding for r in sorted(docs, key=lambda r: r.vec_id)], np.float64)
    ids = sorted(r.vec_id for r in docs)
    found = {}
    for r in queries.QUERIES["op8_hash_forest"](spark, SF).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in found:
        s = v @ v[ids.index(q)]
        s[ids.index(q)] = -9
        hits += len(found[q] & {ids[i] for i in np.argsort(-s, kind="stable")[:20]})
    assert set(found) == {i for i in ids if i % 20 == 0} and hits / (20 * len(found)) >= 0.9
