"""The driver's tables in the roles that the operators expect, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt over three tasks a core: a table of small rows is one file part, however much work each of its rows is."""
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism, key)


#: Rows a task takes where what is made of a row is much longer than the row.
PART_ROWS = 1 << 18


def parts_of(df: DataFrame) -> int:
    """Tasks of about PART_ROWS rows, three a core at least: long texts that are much alike shrink so far in a shuffle that bytes say little of what a task will hold."""
    return max(3 * df.sparkSession.sparkContext.defaultParallelism, df.count() // PART_ROWS)


#: Documents a query of the lists() view covers.
PER_QUERY = 100


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with a URL that says nothing but the text and a tracking parameter, a title and a snippet (the first and second line), and a date on two of three."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL AND source IS NOT NULL")
    line = lambda i: F.coalesce(F.get(F.split("text", "\n"), F.lit(i)), F.lit(""))
    return docs.select(
        "doc_id", "lang", "source", "n_chars", "text", F.concat(F.lit("http://www."), "lang", F.lit(".example.com/"), F.md5("text"), F.lit("/?utm_source="), "source").alias("url"), line(0).alias("title"), line(1).alias("snippet"),
        F.when(F.col("doc_id") % 3 != 0, F.date_format(F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("doc_id") % 400).cast("int")), "yyyy-MM-dd")).alias("published"),
    )


DOCUMENTS_SQL = """docs AS (
  SELECT doc_id, lang, source, n_chars, text, 'http://www.' || lang || '.example.com/' || md5(text) || '/?utm_source=' || source AS url,
         'https://' || lang || '.example.com/' || md5(text) AS page,
         coalesce(string_split(text, chr(10))[1], '') AS title, coalesce(string_split(text, chr(10))[2], '') AS snippet,
         CASE WHEN doc_id % 3 <> 0 THEN strftime(DATE '2024-01-01' + CAST(doc_id % 400 AS INTEGER), '%Y-%m-%d') END AS published
  FROM documents WHERE text IS NOT NULL AND source IS NOT NULL)"""


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked lists: a query is a hundred documents, a provider their source, the rank their order by id."""
    docs = documents(spark, sf_dir).withColumn("query_id", F.floor(F.col("doc_id") / PER_QUERY))
    pos = F.regexp_extract("source", r"(\d+)$", 1).try_cast("int")
    rank = (F.row_number().over(Window.partitionBy("query_id", "source").orderBy("doc_id")) - 1).cast("int")
    return docs.select("query_id", F.col("source").alias("provider"), F.coalesce(pos, F.lit(0)).alias("provider_pos"), rank.alias("rank"), "url", "title", "snippet", "published", "doc_id", "lang")


LISTS_SQL = DOCUMENTS_SQL + """, lists AS (
  SELECT doc_id // 100 AS query_id, source AS provider, coalesce(TRY_CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER), 0) AS provider_pos,
         CAST(row_number() OVER (PARTITION BY doc_id // 100, source ORDER BY doc_id) - 1 AS INTEGER) AS rank, url, page, title, snippet, published, doc_id, lang
  FROM docs)"""

#: Place of the wire service among the sources.
WIRE_POS = 99


def wired_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lists(), and a wire service that repeats every third document on its own domain with a word more."""
    own = lists(spark, sf_dir)
    rank = (F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")) - 1).cast("int")
    wire = own.where("doc_id % 3 = 0").withColumns({"provider": F.lit("wire"), "provider_pos": F.lit(WIRE_POS), "rank": rank, "url": F.concat(F.lit("https://wire.example.org/"), F.regexp_extract("url", "/([0-9a-f]{32})/", 1)), "snippet": F.concat("snippet", F.lit(" today"))})
    return own.unionByName(wire)


WIRED_SQL = LISTS_SQL.replace(", lists AS (", ", plain_lists AS (") + f""", lists AS (SELECT * FROM plain_lists UNION ALL
  SELECT query_id, 'wire', {WIRE_POS}, CAST(row_number() OVER (PARTITION BY query_id ORDER BY doc_id) - 1 AS INTEGER), 'https://wire.example.org/' || regexp_extract(page, '([0-9a-f]{{32}})$', 1), 'https://wire.example.org/' || regexp_extract(page, '([0-9a-f]{{32}})$', 1),
         title, snippet || ' today', published, doc_id, lang FROM plain_lists WHERE doc_id % 3 = 0)"""

DEDUPED_SQL = LISTS_SQL + """, grouped AS (
  SELECT query_id, provider, provider_pos, page, min(rank) AS rank, count(*) AS copies, arg_min(url, rank) AS url,
         arg_min(title, rank) FILTER (title <> '') AS title, arg_min(snippet, rank) FILTER (snippet <> '') AS snippet, arg_min(published, rank) FILTER (published <> '') AS published
  FROM lists GROUP BY ALL),
deduped AS (SELECT *, row_number() OVER (PARTITION BY query_id, provider ORDER BY rank) - 1 AS pos FROM grouped)"""

FUSED_SQL = DEDUPED_SQL + """, summed AS (
  SELECT query_id, page, round(sum(weight / (60.0::DOUBLE + pos + 1)), 12) AS score, count(DISTINCT provider) AS agreement,
         arg_min({'u': url, 't': title, 's': snippet, 'p': published}, (rank * 1000 + provider_pos) * 1000 + pos) AS best, min(provider_pos * 1000 + pos) AS seen,
         arg_min(published, provider_pos * 1000 + pos) FILTER (published <> '') AS dated,
         array_to_string(list_sort(list(DISTINCT provider)), ',') AS sources
  FROM weighted GROUP BY query_id, page),
fused AS (
  SELECT query_id, page, best.u AS url, best.t AS title, best.s AS snippet, coalesce(best.p, dated) AS published, sources, agreement, score,
         row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS place
  FROM summed)"""
EVEN_SQL = ", weighted AS (SELECT *, 1.0::DOUBLE AS weight FROM deduped)"
#: A source's weight for a query, from its place among 20 sources.
WEIGHT_SQL = ", weighted AS (SELECT *, 1.0::DOUBLE + (provider_pos % 4) / 4.0::DOUBLE AS weight FROM deduped)"


def fused_sql(weights: str = EVEN_SQL, wired: bool = False) -> str:
    head, tail = (FUSED_SQL.replace(LISTS_SQL, WIRED_SQL) if wired else FUSED_SQL).split(", summed AS", 1)
    return f"WITH {head}{weights}, summed AS{tail}"


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a call log: a provider a user, failures the errors, latencies the values, seconds since 1970."""
    events = table(spark, sf_dir, "events").where("user_id IS NOT NULL AND ts IS NOT NULL")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return events.select("event_id", F.col("user_id").alias("provider"), "ts", seconds.alias("at_s"), (F.col("event_type") != "error").alias("ok"), F.coalesce("value", F.lit(0.0)).alias("latency_ms"), "event_type", "props", (F.col("event_id") % 3).cast("int").alias("tier"))


CALLS_SQL = """calls AS (
  SELECT event_id, user_id AS provider, ts, epoch_us(ts) / 1e6 AS at_s, event_type <> 'error' AS ok, coalesce(value, 0.0) AS latency_ms, event_type, props, CAST(event_id % 3 AS INTEGER) AS tier
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
logged AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY event_id) AS i FROM calls)"""


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as offers: a part is a product, a supplier a seller, its nation a currency, the return flag an availability."""
    line, supplier, part = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "part"))
    currency = F.element_at(F.array(*[F.lit(c) for c in ("USD", "EUR", "GBP")]), (F.col("s_nationkey") % 3 + 1).cast("int"))
    sold = line.join(supplier, line["l_suppkey"] == supplier["s_suppkey"]).join(part, line["l_partkey"] == part["p_partkey"])
    return sold.select(
        F.floor(F.col("l_partkey") / 40).alias("group"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("identity"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
        F.concat(F.lit("https://www.shop"), F.col("l_suppkey").cast("string"), F.lit(".example.com/p/"), F.col("l_partkey").cast("string"), F.lit("?ref="), F.col("l_orderkey").cast("string")).alias("url"), F.col("p_name").alias("title"),
        F.col("s_name").alias("seller"), F.when(F.col("l_linenumber") % 2 == 0, F.col("p_brand")).otherwise("").alias("brand"), F.lit("").alias("image"), currency.alias("currency"),
        F.when(F.col("l_linenumber") != 7, F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100) / 100).alias("amount"), F.when(F.col("l_returnflag") == "R", "SoldOut").otherwise("").alias("availability"), F.col("l_linestatus").alias("condition"),
        F.when(F.col("l_linenumber") == 3, F.col("l_discount") * 10).alias("rating"), F.when(F.col("l_linenumber") == 4, F.col("l_quantity").cast("int")).alias("reviews"),
    )


OFFERS_SQL = """offers AS (
  SELECT l_partkey // 40 AS grp, 'part:' || l_partkey AS identity, l_orderkey * 10 + l_linenumber AS pos, 'https://shop' || l_suppkey || '.example.com/p/' || l_partkey AS page,
         'https://www.shop' || l_suppkey || '.example.com/p/' || l_partkey || '?ref=' || l_orderkey AS url,
         p_name AS title, s_name AS seller, CASE WHEN l_linenumber % 2 = 0 THEN p_brand ELSE '' END AS brand, ['USD', 'EUR', 'GBP'][s_nationkey % 3 + 1] AS currency,
         CASE WHEN l_linenumber <> 7 THEN floor(l_extendedprice / l_quantity * 100) / 100 END AS amount, CASE WHEN l_returnflag = 'R' THEN 'SoldOut' ELSE '' END AS availability,
         CASE WHEN l_linenumber = 3 THEN l_discount * 10 END AS rating, CASE WHEN l_linenumber = 4 THEN CAST(l_quantity AS INTEGER) END AS reviews
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"""
