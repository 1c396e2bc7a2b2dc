"""Queries against their SQL on rows that only larger tables hold, and how often rows move."""

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathomline.operators import fusion, items
from fathomline.plans import pages as _pages  # noqa: F401
from fathomline.plans import queries
from fathomline.plans import reading as _reading  # noqa: F401
from fathomline.plans import sources as _sources
from fathomline.plans import tables as T
from fathomline.sources import captures, objects, records
from oracle import rows_of

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


def same_as_sql(spark, folder, name, **tables):
    con = duckdb.connect()
    for table, df in tables.items():
        df.write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    got = queries.QUERIES[name](spark, str(folder))
    result = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    rows = rows_of(got.columns, got.collect())
    assert rows and rows == rows_of(columns, result.fetchall())


def test_copies_of_a_page_in_other_languages_ground_each_other(spark, tmp_path):
    rows = [(0, "one text", "en", "src1", 8), (100, "one text", "fr", "src2", 8), (200, "one text", None, None, 8), (301, "other", "en", "src1", 5), (501, "", "en", None, 0), (601, None, "en", "src1", 0)]
    same_as_sql(spark, tmp_path, "citation_grounding", documents=spark.createDataFrame(rows, DOCUMENTS))


def test_a_title_of_blanks_is_no_title(spark, tmp_path):
    rows = [(i, text, "en", "src1", 9) for i, text in enumerate(["A title\nmore", "1 - 2\nmore", "12\nmore", " 7  B \nmore", "\nmore"])]
    same_as_sql(spark, tmp_path, "crossref_answers", documents=spark.createDataFrame(rows, DOCUMENTS))


def test_reasons_of_marks_that_lie_close(spark, tmp_path):
    rows = [(i, f"text {i}", "en", f"src{i % 23}", 6) for i in range(60_000) if i % 7 < 2 + i // 1000 % 5]
    same_as_sql(spark, tmp_path, "deadline_cut", documents=spark.createDataFrame(rows, DOCUMENTS))


def test_pages_with_one_lighter_form(spark, tmp_path):
    rows = [(i, "", "") for i in (1, 2, 4, 8, 90_001, 180_001, 90_002)]
    same_as_sql(spark, tmp_path, "lean_read", pages=spark.createDataFrame(rows, "page_id long, url string, html string"))


@pytest.mark.parametrize("name", ["state_listings", "page_texts"])
def test_a_year_inside_a_longer_number_is_said(spark, tmp_path, name):
    rows = [(key, "goldenrod lace", "Brand#12", "T", 7, 920.5) for key in (20_201, 20_205, 120_201, 1_020_209, 13)]
    same_as_sql(spark, tmp_path, name, part=spark.createDataFrame(rows, PART))


def test_offers_move_once(spark):
    row = "id % 3 AS `group`, concat('part:', id) AS identity, id AS pos, 'https://s.com/a' AS url, 't' AS title, 's' AS seller, '' AS brand, '' AS image, 'USD' AS currency, 1.0D AS amount, '' AS availability, '' AS condition, 1.0D AS rating, 1 AS reviews"
    offers = spark.sql(f"SELECT {row} FROM range(10)")
    for made in (items.products(offers), items.merge_items(offers)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
    assert items.merge_items(offers).where(F.col("place") == 1).count() == 3


@pytest.mark.parametrize("name", ["page_content", "listing_rows", "doi_records"])
def test_pages_made_of_one_file_are_dealt_to_all_cores(spark, tmp_path, name):
    spark.createDataFrame([(1, "goldenrod lace", "Brand#12", "T", 7, 920.5)], PART).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    plan = queries.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(p_partkey#" in plan and f", {3 * spark.sparkContext.defaultParallelism}), REPARTITION_BY_NUM" in plan


def test_objects_of_many_pages_come_in_few_batches():
    html = '<script>var a = {"vin": "1ABCD23E4F5G67891", "price": 5}</script>'
    n = 3 * records.BATCH_ROWS
    pages = pa.RecordBatch.from_pydict({"page_id": list(range(n)), "page": ["https://a.com/"] * n, "html": [html] * n})
    assert [b.num_rows for b in records.opened([pages])] == [records.BATCH_ROWS] * 3


def test_pages_are_read_for_marks_once(spark, tmp_path, monkeypatch):
    calls = []
    real = records.page_marks
    monkeypatch.setattr(records, "page_marks", lambda pages: calls.append(pages) or real(pages))
    html = "<div data-item='{\"name\":\"goldenrod\",\"price\":5,\"sku\":\"K100000\"}'></div><a href=\"/d/K100000-x\">open</a>"
    rows = [(1, "https://a.com/list", html), (2, "https://a.com/list", "<a href=\"/d/1\">open</a>"), (3, "https://a.com/list", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = records.generic_listings(pages)
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r.page_id, r.link) for r in found.collect()] == [(1, "https://a.com/d/K100000-x")]
    assert [r.page_id for r in calls[0].collect()] == [1]


def test_sets_of_shingles_move_as_hashes(spark):
    rows = [(1, 1, "https://a.com/1", "one two three four", "five"), (1, 2, "https://b.com/1", "one two three four", "five"), (1, 3, "https://c.com/1", "other words than these", "")]
    fused = spark.createDataFrame(rows, "query_id long, place long, url string, title string, snippet string")
    assert dict(fusion._pages(fused).dtypes)["set"] == "array<bigint>"
    assert [(r.first, r.second, r.similarity) for r in fusion.similar_pairs(fused).collect()] == [(1, 2, 1.0)]


def test_objects_of_long_pages_come_in_small_batches(spark):
    page = "x" * 1000 + '{"at":{"n":1}} "at": {"n":2} "at":'
    rows = spark.range(0, 1200, 1, 1).select("id", F.concat(F.lit(page), F.col("id").cast("string")).alias("html"))
    found = rows.select("id", objects.objects_column(F.col("html"), '"at":').alias("found"), objects.objects_column(F.lit(None).cast("string"), '"at":').alias("none"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan  # a hundred pages a batch, not 10,000
    assert {(tuple(r.found), tuple(r.none)) for r in found.collect()} == {(('{"n":1}', '{"n":2}'), ())} and found.count() == 1200


def test_links_are_dealt_once_as_numbers_and_by_their_count(spark, tmp_path, monkeypatch):
    lines = [(i // 7, i * 5 % 300, i % 7 + 1) for i in range(1400)] + [(3, 105, 1), (3, 105, 9)]
    part = spark.createDataFrame([(i, f"part {i}", "Brand#1", "T", 7, 900.0 + i) for i in range(300)], PART)
    monkeypatch.setattr(T, "PART_ROWS", 60)
    same_as_sql(spark, tmp_path, "marketplace_items", part=part, lineitem=spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int"))
    plan = queries.QUERIES["marketplace_items"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" not in plan and "hashpartitioning(l_orderkey" in plan and ", 23), REPARTITION_BY_NUM" in plan


def test_captures_make_no_folder_a_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(_sources, "fresh_path", lambda spark, label: f"{tmp_path}/{label}")
    rows = [(i, f"text {i}", "en", "src1", 9) for i in range(400)]
    same_as_sql(spark, tmp_path, "captured_answers", documents=spark.createDataFrame(rows, DOCUMENTS))
    folders = [p for p in (tmp_path / "captures").rglob("*") if p.is_dir()]
    assert len(folders) == 3 + 6 and not list((tmp_path / "captures").rglob("query=*"))
    found = captures.packed(spark, f"{tmp_path}/captures")
    assert found.count() == 20
    plan = captures.answers(found.where("day = DATE'2024-05-01'"), ["ddg"])._jdf.queryExecution().executedPlan().toString()
    assert "day" in (read := plan.split("PartitionFilters:")[1].split("]")[0]) and "provider" in read


def test_packed_captures_are_read_as_single_files(spark, tmp_path):
    rows = [("wikipedia", "2024-01-01", 1, '{"query":{"search":[{"title":"A b"}]}}'), ("wikipedia", "2024-01-01", 1, '{"error":{"info":"slow down"}}'), ("ddg", "2024-01-02", 7, ""), ("other", "2024-01-01", 1, "two\nlines")]
    made = spark.createDataFrame(rows, "provider string, day string, query long, body string")
    made.write.partitionBy(*captures.LAYOUT).text(f"{tmp_path}/single")
    captures.pack(made, f"{tmp_path}/packed")
    captures.pack(made.limit(0), f"{tmp_path}/none")
    single, packed = captures.captures(spark, f"{tmp_path}/single"), captures.packed(spark, f"{tmp_path}/packed")
    assert single.dtypes == packed.dtypes and captures.packed(spark, f"{tmp_path}/none").count() == 0
    told = lambda found: sorted(str(r) for r in captures.answers(found).collect())
    assert sorted((r.provider, str(r.day), r.query, r.body) for r in packed.collect()) == sorted(rows)
    assert len(told(packed)) == 2 and told(single) == told(packed)
