"""Chat formatting as relations: collected and sorted turn structs, merged roles, one string a conversation.

Template (each mark begins with ``<``, which no escaped text holds)::

    <turn:ROLE>\\n text <and:ROLE>\\n text ... </turn>\\n

``<turn:`` opens a run of adjacent turns of one role, ``<and:`` joins the next turn of the same run.
Texts and roles are escaped reversibly: a backslash becomes ``\\b``, ``<`` becomes ``\\l`` and, in
roles, ``>`` becomes ``\\g``. The loss mask covers the texts of assistant turns, without marks.

Everything is Spark expressions: arrays are sliced and joined, never appended to one by one, so the
work is linear in the turns of a conversation. A conversation is one output row by its nature, and
its turns meet in one task; rows of different conversations are grouped by hash.

Null text or role: empty. Null conversation id: one conversation. Turns are sorted by turn (nulls
first), then role, then text, so repeated turn numbers and repeated rows have a fixed place. An empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    # after escaping, each backslash is followed by its own letter, so the steps cannot meet
    return F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")), F.lit("\\b"), F.lit("\\"))


def format_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, n_turns, n_runs, formatted), a row a conversation."""
    one = F.struct(turns[turn_col].cast("long").alias("turn"), F.coalesce(turns[role_col].cast("string"), F.lit("")).alias("role"), F.coalesce(turns[text_col].cast("string"), F.lit("")).alias("text"))
    rows = turns.select(turns[id_col].alias("key"), one.alias("one")).groupBy("key").agg(F.array_sort(F.collect_list("one")).alias("turns"))
    turn = lambda i: F.get("turns", i)
    opens = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (turn(i)["role"] != turn(i - 1)["role"]))
    rows = rows.withColumn("opens", opens)
    after = lambda k: F.coalesce(F.get("opens", k + 1), F.size("turns"))
    runs = F.transform("opens", lambda at, k: F.struct(F.replace(escaped(turn(at)["role"]), F.lit(">"), F.lit("\\g")).alias("role"), F.transform(F.slice("turns", at + 1, after(k) - at), lambda t: escaped(t["text"])).alias("texts")))
    joined = lambda run: F.concat(F.lit("<and:"), run["role"], F.lit(">\n"))
    # array_join takes a fixed delimiter only, so the texts after the first get their mark before the join
    marked = F.transform("runs", lambda run: F.struct(run["role"].alias("role"), F.transform(run["texts"], lambda t, i: F.when(i == 0, t).otherwise(F.concat(joined(run), t))).alias("texts")))
    rows = rows.withColumn("runs", runs).withColumn("runs", marked)
    whole = F.array_join(F.transform("runs", lambda run: F.concat(F.lit("<turn:"), run["role"], F.lit(">\n"), F.array_join(run["texts"], ""), F.lit("</turn>\n"))), "")
    return rows.select(F.col("key").alias(id_col), F.size("turns").cast("long").alias("n_turns"), F.size("opens").cast("long").alias("n_runs"), whole.alias("formatted"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, from its marks."""
    parts = F.slice(F.split(formatted, "<"), 2, F.length(formatted) + 1)
    parts = F.filter(parts, lambda p: ~p.startswith("/turn>"))
    tag = lambda p: F.substring_index(p, ">\n", 1)
    return F.transform(parts, lambda p: F.struct(unescaped(_after_colon(tag(p))).alias("role"), unescaped(F.substr(p, F.length(tag(p)) + 3)).alias("text")))


def _after_colon(tag: Column) -> Column:
    return F.substr(tag, F.instr(tag, ":") + 1)


def digests(formatted: DataFrame, id_col: str = "conv_id", role: str = "assistant") -> DataFrame:
    """Counts and hashes of what read_back finds, under the loss mask and in all."""
    read = formatted.withColumn("read", read_back(F.col("formatted")))
    read = read.withColumn("loss", F.array_join(F.transform(F.filter("read", lambda t: t["role"] == role), lambda t: t["text"]), ""))
    every = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(id_col, F.size("read").cast("long").alias("n_turns"), F.sha2(every, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
