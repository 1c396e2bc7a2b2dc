"""The thin queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import encode_texts
from .conversation_repair import damaged, repair
from .decontaminate import contamination
from .chat_format import digests, format_conversations
from .hash_forest import nearest
from .hilbert_shards import shard_rows
from .language_id import held_out, identify
from .language_id import train as train_languages
from .near_dedup import near_duplicates
from .packing import pack
from .toxicity_chain import predict
from .toxicity_chain import train as train_toxicity
from .token_count import count_tokens
from .token_store import store_digest
from .whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, num=85, den=100)


#: Every pair that shares a shingle, and every id that reaches another; for small tables.
_OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM words),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS c
  FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM common WHERE 100 * c >= 85 * (nx + ny - c)),
ends AS (SELECT x AS u, y AS v FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS node, doc_id AS low FROM sets UNION SELECT ends.v, reach.low FROM reach JOIN ends ON ends.u = reach.node AND reach.low < ends.v),
components AS (SELECT node, min(low) AS component_id FROM reach GROUP BY node)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN components ON node = doc_id
"""


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


#: The chain: poor quality first, whose probability the toxicity model sees.
CHAIN = ["low_quality=1 - quality", "toxic"]


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    chain = train_toxicity(docs, _table(spark, sf_dir, "labels"), CHAIN)
    return predict(docs, chain).withColumn("is_toxic", F.col("p_toxic") >= chain.links[-1].threshold)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = identify(docs, train_languages(docs.where(~held_out(docs))))
    return found.withColumn("held_out", held_out(found))


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_rows(_table(spark, sf_dir, "documents"), ["lang", "source", "n_chars"], 8)
    return rows.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


#: A conversation that holds the template's own and other templates' marks.
MARKED_TEXT = "\\### Assistant: </turn> ok"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.range(2).select(F.lit(-7).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(MARKED_TEXT))
    return digests(format_conversations(turns.union(marked)))


_OP9_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
placed AS (
  SELECT *, lag(role) OVER w AS before, replace(replace(text, '\', '\b'), '<', '\l') AS escaped,
         row_number() OVER w AS place
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(escaped) + length(role) + CASE WHEN before IS NULL THEN 16 WHEN before = role THEN 7 ELSE 16 END) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS long)"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = encode_texts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return read.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(_table(spark, sf_dir, "conversations")))


#: Signatures are folded from their ends; of each state (1 nothing, 2 a system turn, 3 whole pairs, 4 a user turn) the best so far is its
#: cost in nine digits before its audit, so the least string is the least cost and then the least audit.
_OP13_SQL = r"""
WITH source AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
dealt AS (
  SELECT *, xor(list_reduce(list_transform(string_split(name, ''), lambda ch: CAST(ascii(ch) AS BIGINT)),
                            lambda c, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)),
                            CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS dealt FROM source),
damaged AS (
  SELECT conv_id, turn, CASE WHEN dealt = 4 THEN 'user' ELSE role END AS role,
         CASE dealt WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN dealt = 3 THEN 2 ELSE 1 END)) AS copy FROM dealt WHERE dealt <> 0),
placed AS (
  SELECT *, left(role, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen FROM damaged),
judged AS (
  SELECT *, CASE WHEN bare = '' THEN 1 WHEN seen THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY place) AS before FROM placed),
coded AS (
  SELECT *, CASE WHEN fault IN (1, 2) THEN '-' WHEN initial NOT IN ('s', 'u', 'a') THEN CASE fault WHEN 3 THEN 'X' ELSE 'x' END
                 WHEN fault = 3 THEN upper(initial) ELSE initial END AS code FROM judged),
read AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
         count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, list(code ORDER BY place DESC) AS back FROM coded GROUP BY conv_id),
solved AS (
  SELECT *, list_reduce(list_concat(back, ['.']), lambda v, ch:
      list_transform([[
        list_min([v[1], lpad(CAST(CAST(left(v[4], 9) AS INT) + 3 AS VARCHAR), 9, '0') || 'I' || substr(v[4], 10), lpad(CAST(CAST(left(v[3], 9) AS INT) + 6 AS VARCHAR), 9, '0') || 'II' || substr(v[3], 10)]),
        list_min([v[2], lpad(CAST(CAST(left(v[4], 9) AS INT) + 3 AS VARCHAR), 9, '0') || 'I' || substr(v[4], 10), lpad(CAST(CAST(left(v[3], 9) AS INT) + 6 AS VARCHAR), 9, '0') || 'II' || substr(v[3], 10)]),
        list_min([v[3], lpad(CAST(CAST(left(v[4], 9) AS INT) + 3 AS VARCHAR), 9, '0') || 'I' || substr(v[4], 10)]),
        list_min([v[4], lpad(CAST(CAST(left(v[3], 9) AS INT) + 3 AS VARCHAR), 9, '0') || 'I' || substr(v[3], 10)])]],
      lambda w: CASE WHEN ch = '.' THEN w ELSE list_transform([1, 2, 3, 4], lambda s: list_min(list_transform(list_filter([
          {'goes': s, 'cost': 4, 'edit': 'D'},
          {'goes': CASE WHEN ch = '-' THEN 0 WHEN s = 4 THEN 3 ELSE 4 END, 'cost': 3 + CASE WHEN ch = upper(ch) THEN 3 ELSE 0 END, 'edit': 'R'},
          {'goes': CASE WHEN lower(ch) = 's' AND s = 1 THEN 2 WHEN lower(ch) = 'u' AND s <> 4 THEN 4 WHEN lower(ch) = 'a' AND s = 4 THEN 3 ELSE 0 END, 'cost': CASE WHEN ch = upper(ch) THEN 3 ELSE 0 END, 'edit': 'K'}],
        lambda o: o.goes > 0), lambda o: lpad(CAST(CAST(left(w[o.goes], 9) AS INT) + o.cost AS VARCHAR), 9, '0') || o.edit || substr(w[o.goes], 10)))) END)[1],
    ['000000000', '099999999', '000000000', '099999999'])[1] AS best FROM read),
edits AS (
  SELECT conv_id, unnest(string_split(substr(best, 10), '')) AS edit, generate_subscripts(string_split(substr(best, 10), ''), 1) AS step FROM solved WHERE length(best) > 9),
steps AS (
  SELECT *, count(*) FILTER (edit <> 'I') OVER w AS place, count(*) FILTER (edit <> 'D') OVER w AS written FROM edits
  WINDOW w AS (PARTITION BY conv_id ORDER BY step ROWS UNBOUNDED PRECEDING)),
kept AS (
  SELECT s.conv_id, s.edit, s.written, c.role, CASE WHEN s.edit = 'I' THEN '' ELSE c.text END AS text, c.initial
  FROM steps s LEFT JOIN coded c ON s.edit <> 'I' AND c.conv_id IS NOT DISTINCT FROM s.conv_id AND c.place = s.place WHERE s.edit <> 'D'),
led AS (SELECT *, max(CASE WHEN written = 1 AND edit = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS system FROM kept),
repaired AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (written - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY written) AS whole
  FROM led GROUP BY conv_id)
SELECT o.conv_id, coalesce(s.gaps, 0) AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate, coalesce(s.truncated, 0) AS truncated,
       coalesce(s.illegal, 0) AS illegal, coalesce(CAST(left(s.best, 9) AS BIGINT), 0) AS cost, coalesce(substr(s.best, 10), '') AS audit, sha256(coalesce(r.whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
"""


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_toxicity": op3_toxicity,
    "op4_language_id": op4_language_id,
    "op5_hilbert_shards": op5_hilbert_shards,
    "op6_token_counts": op6_token_counts,
    "op7_packing": op7_packing,
    "op8_hash_forest": op8_hash_forest,
    "op9_chat_format": op9_chat_format,
    "op10_token_store": op10_token_store,
    "op11_whitening": op11_whitening,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLE_SQL: dict[str, str] = {"op1_near_dedup": _OP1_SQL, "op9_chat_format": _OP9_SQL, "op13_conversation_repair": _OP13_SQL}
