"""Choosing sources for a query: capability, trust for the intent, health and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Trust in a source for an intent (1 where absent), and for queries with a freshness bound.
AFFINITY = {
    "academic": {"openalex": 2.0, "arxiv": 1.8, "crossref": 1.6, "wikipedia": 1.2, "duckduckgo": 0.8, "bing": 0.6},
    "code": {"github": 2.0, "stackexchange": 1.8, "hackernews": 1.2, "duckduckgo": 1.0},
    "reference": {"wikipedia": 2.2, "duckduckgo": 1.0, "bing": 0.8},
    "shopping": {"marketplace": 2.0, "sidecar_listings": 1.4, "duckduckgo": 1.0, "bing": 0.7},
    "forum": {"hackernews": 1.8, "stackexchange": 1.6, "duckduckgo": 1.0},
    "news": {"duckduckgo": 1.2, "bing": 1.0, "hackernews": 1.0},
    "video": {"youtube": 2.2, "duckduckgo": 1.0, "bing": 0.8},
    "local": {"sidecar_listings": 1.6, "duckduckgo": 1.0},
    "web": {"duckduckgo": 1.4, "bing": 1.0, "wikipedia": 0.9},
}
FRESH_AFFINITY = {"bing": 1.4, "hackernews": 1.6, "youtube": 1.4, "duckduckgo": 0.7}
GENERALISTS = ["duckduckgo", "bing", "marginalia"]


def affinities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, p, w) for i, row in AFFINITY.items() for p, w in row.items()], "intent string, provider string, affinity double")


def fresh_affinities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FRESH_AFFINITY.items()), "provider string, fresh double")


def health_score(success: Column, latency_ms: Column, is_open: Column) -> Column:
    return F.when(is_open, 0.0).otherwise(0.8 * success + 0.2 / (1.0 + latency_ms / 2000.0))


def cooldown_s(hold_s: Column, base_s: Column, trips: Column) -> Column:
    """How long a breaker stays open."""
    backed_off = F.least(F.lit(120.0), base_s * F.pow(F.lit(2.0), F.greatest(trips - 1, F.lit(0))))
    return F.when(hold_s > 0, hold_s).when(base_s <= 0, 120.0).otherwise(backed_off)


def timeout_s(cap: Column, ema_latency_ms: Column, calls: Column) -> Column:
    return F.when(calls < 3, cap).otherwise(F.least(cap, F.greatest(F.lit(2.0), 3.0 * ema_latency_ms / 1000.0 + 1.0)))


def select_providers(queries: DataFrame, providers: DataFrame, n: int, allow_expensive: bool = False) -> DataFrame:
    """(query_id, provider, score, place): the best sources of each query.

    queries: query_id, intent, freshness; providers (a small table: the registry): provider, pos,
    intents, cost, success, latency_ms, open. A query whose choice holds no generalist gets one in its
    last place, unless it is shopping.
    """
    spark = queries.sparkSession
    registry = providers.join(F.broadcast(fresh_affinities(spark)), "provider", "left")
    each = queries.join(F.broadcast(_by_intent(registry)), "intent")
    usable = each.where(~F.col("open") & (F.lit(allow_expensive) | (F.col("cost") <= 0)))
    trusted = usable.join(F.broadcast(affinities(spark)), ["intent", "provider"], "left")
    fresh = F.when(F.col("freshness") == "all", 1.0).otherwise(F.coalesce("fresh", F.lit(1.0)))
    score = health_score(F.col("success"), F.col("latency_ms"), F.col("open")) * F.coalesce("affinity", F.lit(1.0)) * fresh / (1.0 + F.col("cost") / 5.0)
    ranked = trusted.withColumn("score", score).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "pos"))).where(F.col("place") <= n)
    # the generalist that stands in: the first of the fixed order that is not cooling
    rank = F.array_position(F.array(*[F.lit(g) for g in GENERALISTS]), F.col("provider"))
    spare = providers.where(F.col("provider").isin(GENERALISTS) & ~F.col("open")).orderBy(rank).limit(1).select(F.col("provider").alias("stand_in"))
    per = Window.partitionBy("query_id")
    lacking = (F.max(F.col("provider").isin(GENERALISTS).cast("int")).over(per) == 0) & (F.col("intent") != "shopping")
    chosen = ranked.withColumn("lacking", lacking).select("query_id", "provider", "score", "place", "lacking", F.max("place").over(per).alias("last"))
    stay = chosen.where(~F.col("lacking") | (F.col("place") <= F.lit(n - 1)))
    added = chosen.where(F.col("lacking") & (F.col("place") == F.col("last"))).crossJoin(F.broadcast(spare)).select("query_id", F.col("stand_in").alias("provider"), F.lit(None).cast("double").alias("score"), F.least(F.col("last") + 1, F.lit(n)).alias("place"))
    return stay.select("query_id", "provider", "score", "place").unionByName(added)


def _by_intent(providers: DataFrame) -> DataFrame:
    return providers.withColumn("intent", F.explode("intents")).drop("intents")


def walled(asked: DataFrame, key: str) -> DataFrame:
    """(key, walled) of what was asked of sources (key, provider, state: used, failed, late or skipped): whether general engines were asked and none answered, so that one costed source may be tried."""
    general = F.col("provider").isin(GENERALISTS)
    tried, answered = F.max(F.when(general, F.lit(1)).otherwise(0)), F.max(F.when(general & (F.col("state") == "used"), 1).otherwise(0))
    return asked.groupBy(key).agg(((tried == 1) & (answered == 0)).alias("walled"))


def cooling(queries: DataFrame, providers: DataFrame) -> DataFrame:
    """(query_id, provider, note): the sources a query lost to open breakers: those that serve its intent, and general engines but for shopping. providers (small): provider, intents, open, streak, last_error, left_s."""
    broken = F.broadcast(providers.where("open"))
    serves = F.array_contains("intents", F.col("intent")) | (F.col("provider").isin(GENERALISTS) & (F.col("intent") != "shopping"))
    note = F.concat(F.lit("circuit open: "), F.col("streak").cast("string"), F.lit(" consecutive failures, last '"), "last_error", F.lit("', cooling for "), F.greatest(F.floor("left_s"), F.lit(0)).cast("string"), F.lit("s"))
    return queries.join(broken, serves).select("query_id", "provider", note.alias("note"))


def refused_if_cooling(answers: DataFrame, lost: DataFrame) -> DataFrame:
    """answers (query_id, docs) with ``outcome``: ``answered``, ``empty``, or ``refused`` where nothing was found while sources were cooling."""
    n = lost.groupBy("query_id").agg(F.count(F.lit(1)).alias("cooling"))
    return answers.join(n, "query_id", "left").withColumn("outcome", F.when(F.col("docs") > 0, "answered").when(F.col("cooling") > 0, "refused").otherwise("empty")).drop("cooling")
