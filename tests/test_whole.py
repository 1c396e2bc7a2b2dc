"""Jobs done whole: no row is lost to a bound, a sketch or a size."""

import json

from fathomline.sources import serp
from fathomline.streaming import live


def test_all_cards_of_a_page(spark):
    card = lambda i: json.dumps({"videoRenderer": {"videoId": f"v{i}", "title": {"runs": [{"text": f"t{i}"}]}}})
    body = "var ytInitialData = {\"contents\":[" + ",".join(card(i) for i in [*range(1203), 5, 6]) + "]}"
    got = serp.video_cards(spark.createDataFrame([(1, body), (2, card(0))], "query_id long, body string")).collect()
    assert sorted((r.query_id, r["rank"], r.title) for r in got) == [(1, i, f"t{i}") for i in range(1203)] + [(2, 0, "t0")]


def test_sources_that_share_a_register_both_count(spark, tmp_path):
    ddl = "query_id long, provider string, pos int, page string"
    pairs = [(i, f"src{a}", 0, "p") for i, two in enumerate([(0, 17), (0, 1), (5, 5)]) for a in two]
    assert {r.query_id: r.agreement for r in live.progressive_fusion(spark.createDataFrame(pairs, ddl)).collect()} == {0: 2, 1: 2, 2: 1}
    for n, row in enumerate(pairs):  # a file an arrival
        spark.createDataFrame([row], ddl).coalesce(1).write.parquet(str(tmp_path / "a" / f"n={n}"))
    stream = spark.readStream.schema(ddl + ", n int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "a"))
    shown = live.run_to_end(live.progressive_fusion(stream), "update", "whole-fusion").collect()
    assert {q: max((r.batch, r.agreement) for r in shown if r.query_id == q)[1] for q in range(3)} == {0: 2, 1: 2, 2: 1}
