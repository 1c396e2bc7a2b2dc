"""Jobs done whole: no row is lost to a bound, a sketch or a size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.llm import decontaminate, hash_forest, hilbert_shards


@pytest.mark.parametrize("ship_bytes", [1 << 20, 0])
def test_clean_rows_stay_beside_a_contaminated_one_of_their_id(spark, ship_bytes):
    item = "one two three four five six seven eight nine ten eleven twelve"
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    rows = [(None, f"well {item} done"), (None, "a clean text of no id"), (None, None), (3, item), (3, "a clean text of a repeated id"), (3, "another one"), (4, "alone"), (4, "alone")]
    stay = decontaminate.clean(spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int"), bench, ship_bytes=ship_bytes)
    assert stay.columns == ["doc_id", "text", "n"] and sorted(r.n for r in stay.collect()) == [1, 2, 4, 5, 6, 7]


@pytest.mark.parametrize("ship_bytes", [1 << 20, 0])
def test_a_share_at_the_threshold_is_contaminated_either_way(spark, ship_bytes):
    words = [f"w{i}" for i in range(100)]
    bench = spark.createDataFrame([(0, " ".join(words))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(words[:7])), (2, " ".join(words[:6]))], "doc_id long, text string")
    assert [r.doc_id for r in decontaminate.clean(docs, bench, threshold=0.07, ship_bytes=ship_bytes).collect()] == [2]


def test_sources_with_one_beginning_have_their_own_places_on_the_curve(spark):
    rows = [(i, "t", None if i % 10 == 9 else f"https://source_{i % 10}.example.com/") for i in range(200)]
    got = hilbert_shards.shard_rows(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["source"], 4).collect()
    places = {}
    for r in got:
        places.setdefault(rows[r.doc_id][2], set()).add(r.curve)
    curves = [places[s] for s in sorted(places, key=lambda s: s or "")]
    # null shares the lowest quantum with the smallest value, as among numbers
    assert all(len(c) == 1 for c in curves) and sorted(set().union(*curves)) == [min(c) for c in curves[1:]] and curves[0] == curves[1] and len(got) == 200
    none = spark.createDataFrame([(1, "t", None)], "doc_id long, text string, source string")
    assert [r.curve for r in hilbert_shards.shard_rows(none, ["source"], 4).collect()] == [0]


def test_neighbours_that_tie_are_the_smallest_ids(spark):
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(np.eye(60))]
    got = hash_forest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 0, 20).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id) for r in got] == [(i, i) for i in range(1, 21)]
