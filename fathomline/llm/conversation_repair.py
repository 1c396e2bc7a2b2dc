"""Repair of a conversation's turn structure, each distinct signature solved once.

A row's first fault is blank (no character but ASCII white space), duplicate (its role and text stand earlier
in the conversation) or truncated (its last visible character is none of ``.!?``). A signature writes a
conversation as one character a row: ``-`` if the row must go (blank or duplicate), else the initial of its
role, ``s``, ``u``, ``a`` or ``x`` for any other, in upper case if it is truncated. Signatures are counted,
each distinct one is solved by a memoised recursion, and the audits are joined back and replayed over the rows.

Edits: Keep 0, Rerole to user or assistant 3, Delete 4, Insert an empty user or assistant turn 3; a truncated
row that stays adds 3. The audit is the string of the edits' initials that leaves the roles as
``(s?(ua)+)?`` at the least cost, and of those the least in ASCII order. Every place expects one role, so an
audit says what each edit does.

Scale: rows go by conversation twice (to be read, to be replayed), as sorted streams: a conversation is
never gathered, its rows are read as they come, so a task holds one batch, one signature and one audit (a byte a
row). Earlier occurrences are numbered by a window within the same exchange, which spills. What one conversation
costs is sequential by its meaning, as its repaired rows are one hash. A signature that many conversations
share costs one row a conversation: those with ``HOT`` of all conversations or more (at most 1 / HOT of them)
are joined by broadcast if they fit ``SHIP_BYTES``, the others by exchange.

Null role or text: one space. Rows stand by turn (nulls first), then role, then text. A null conversation id
is a conversation. Conversations all of whose rows are dropped have zeros, an empty audit and the hash of an
empty text. An empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import output, written

SPACE = " \t\n\v\f\r"
HOT, SHIP_BYTES = 0.001, 8 << 20
STRIDE = 100

#: What has been written: nothing, a system turn only, whole pairs, a pair's user turn.
START, SYSTEM, EVEN, ODD = range(4)
_NEXT = {START: ODD, SYSTEM: ODD, EVEN: ODD, ODD: EVEN}
_KEEPS = {(START, "s"): SYSTEM, (START, "u"): ODD, (SYSTEM, "u"): ODD, (EVEN, "u"): ODD, (ODD, "a"): EVEN}


def damaged(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, gone): the rows with faults dealt by crc32; dropped rows stay as marks that they were there."""
    named = lambda c: F.coalesce(turns[c].cast("string"), F.lit(" "))
    rows = turns.select(turns[id_col].cast("long").alias("conv"), turns[turn_col].cast("long").alias("turn"), named(role_col).alias("role"), named(text_col).alias("text"), (F.crc32(F.concat(named(id_col), F.lit(":"), named(turn_col)).cast("binary")) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("fault") == 0).alias("gone"), F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")


def plain(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, gone): the rows as they are."""
    named = lambda c: F.coalesce(turns[c].cast("string"), F.lit(" "))
    return turns.select(turns[id_col].cast("long").alias("conv"), turns[turn_col].cast("long").alias("turn"), named(role_col).alias("role"), named(text_col).alias("text"), F.lit(False).alias("gone"))


# solving


@lru_cache(1 << 12)
def solve(signature: str) -> tuple[int, str]:
    """The least cost of a signature, and the ASCII-least audit of that cost."""
    far = len(signature)

    @lru_cache(None)
    def best(at: int, state: int, inserted: int) -> tuple[int, str]:
        """The least cost from a row on, and the first edit of the least audit; two inserts in a row are the most that can help."""
        options = [(0, "")] if at == far and state in (START, EVEN) else []
        if at < far:
            row = signature[at]
            options.append((4 + best(at + 1, state, 0)[0], "D"))
            if row != "-":
                late = 3 * row.isupper()
                if (then := _KEEPS.get((state, row.lower()))) is not None:
                    options.append((late + best(at + 1, then, 0)[0], "K"))
                options.append((3 + late + best(at + 1, _NEXT[state], 0)[0], "R"))
        if inserted < 2:
            options.append((3 + best(at, _NEXT[state], inserted + 1)[0], "I"))
        return min(options, default=(1 << 60, ""))

    for at in range(far, -1, -STRIDE):  # from the end in strides, so that the recursion stays shallow
        for state in range(4):
            best(at, state, 0)
    audit, at, state, inserted = [], 0, START, 0
    while (edit := best(at, state, inserted)[1]) != "":
        audit.append(edit)
        if edit == "I":
            state, inserted = _NEXT[state], inserted + 1
            continue
        if edit == "K":
            state = _KEEPS[state, signature[at].lower()]
        elif edit == "R":
            state = _NEXT[state]
        at, inserted = at + 1, 0
    return best(0, START, 0)[0], "".join(audit)


def solved(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) of distinct signatures."""
    schema = pa.schema([("signature", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])

    def each(batches):
        for batch in batches:
            found = [solve(s) for s in batch.column("signature").to_pylist()]
            yield output(schema, [batch.column("signature"), [f[0] for f in found], [f[1] for f in found]])

    return signatures.select("signature").mapInArrow(each, "signature string, cost long, audit string")


# reading


def _ordered(rows: DataFrame) -> DataFrame:
    """The rows by conversation, each row's repeats numbered, in order: one exchange, two sorts that spill."""
    digest = [F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(1), "role", "text").alias("b")]
    rows = rows.select("*", *digest).repartition("conv")
    again = Window.partitionBy("conv", "a", "b").orderBy("gone", F.col("turn").asc_nulls_first())
    return rows.withColumn("seen", F.row_number().over(again) > 1).sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")


BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
LEGAL = {"su", "ua", "au"}


class _Reading:
    """What is known of the conversation at hand."""

    def __init__(self):
        self.first = self.last = self.before = None
        self.turns = self.illegal = 0
        self.faults = [0, 0, 0, 0]
        self.signature: list[str] = []

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        self.illegal += self.before is not None and self.before + initial not in LEGAL
        self.before = initial
        self.faults[fault] += 1
        role = initial if initial in ("s", "u", "a") else "x"
        self.signature.append("-" if fault in (BLANK, DUPLICATE) else role.upper() if fault == TRUNCATED else role)

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return gaps, *self.faults[1:], self.illegal, "".join(self.signature)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal")), ("signature", pa.string())])
    held, at_hand = None, None
    for batch in batches:
        done = []
        for conv, turn, gone, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "gone", "initial", "fault")), strict=True):
            if held is None or conv != at_hand:
                if held is not None:
                    done.append((at_hand, *held.row()))
                held, at_hand = _Reading(), conv
            if not gone:
                held.add(turn, initial, fault)
        if done:
            yield output(schema, [list(c) for c in zip(*done, strict=True)])
    if held is not None:
        yield output(schema, [[v] for v in (at_hand, *held.row())])


def signatures(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, signature) of each conversation."""
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    whole = F.substring(bare, -1, 1).isin(".", "!", "?")
    fault = F.when(bare == "", BLANK).when(F.col("seen"), DUPLICATE).when(~whole, TRUNCATED).otherwise(0)
    ordered = _ordered(rows).select("conv", "turn", "gone", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))
    return ordered.mapInArrow(_signatures, "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, signature string")


# replaying


class Replay:
    """The repaired rows of one conversation, hashed as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.out = audit, 0, 0
        self.system = False
        self.hash = hashlib.sha256()

    def _write(self, role: str | None, text: str, fresh: str = "") -> None:
        """A row, or one of the expected role if none is given."""
        expected = "user" if (self.out - self.system) % 2 == 0 else "assistant"
        self.system = self.system or (self.out == 0 and role is not None and role[:1] == "s")
        self.hash.update((("\n" if self.out else "") + (expected if role is None else role) + ":").encode())
        self.hash.update(text.encode())
        self.out += 1

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._write(None, "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        if edit != "D":
            self._write(role if edit == "K" else None, text)
        self.at += 1

    def digest(self) -> str:
        self.inserts()
        return self.hash.hexdigest()


#: What a conversation's first row of the stream brings.
_HEAD = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a conversation after one that brings its audit."""
    schema = pa.schema([("conv", pa.int64()), *((n, pa.int64()) for n in _HEAD[:-1]), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    held, known = None, ()
    for batch in batches:
        done = []
        for conv, head, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "head", "role", "text")), strict=True):
            if head is None:
                held.row(role, text)
                continue
            if held is not None:
                done.append((*known, held.digest()))
            held, known = Replay(head["audit"]), (conv, *(head[n] for n in _HEAD))
        if done:
            yield output(schema, [list(c) for c in zip(*done, strict=True)])
    if held is not None:
        yield output(schema, [[v] for v in (*known, held.digest())])


def _with_audits(read: DataFrame) -> DataFrame:
    """The conversations with cost and audit: frequent signatures by broadcast, the others by exchange."""
    counted = written(read.groupBy("signature").agg(F.count("*").alias("n")), "signature-counts")
    answers = written(solved(counted), "signature-audits")
    total = counted.agg(F.sum("n")).first()[0] or 0
    often = counted.where(F.col("n") >= max(2, int(HOT * total))).select("signature")
    size = often.agg(F.sum(2 * F.octet_length("signature") + 64)).first()[0] or 0
    if size > SHIP_BYTES:
        return read.join(answers, "signature")
    wanted = F.broadcast(answers.join(often, "signature"))
    known = read.join(wanted, "signature", "left")
    # a frequent signature has its answer, so only the others are exchanged
    rest = known.where("audit IS NULL").drop("cost", "audit").join(answers.join(often, "signature", "left_anti"), "signature")
    return known.where("audit IS NOT NULL").unionByName(rest)


def repair(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of the conversations of (conv, turn, role, text, gone)."""
    audited = written(_with_audits(written(signatures(rows), "signatures")), "audits")
    no = lambda kind: F.lit(None).cast(kind)
    heads = audited.select("conv", F.struct(*_HEAD).alias("head"), no("long").alias("turn"), no("string").alias("role"), no("string").alias("text"))
    body = rows.where("NOT gone").select("conv", no(heads.schema["head"].dataType).alias("head"), "turn", "role", "text")
    stream = heads.union(body).repartition("conv").sortWithinPartitions("conv", F.col("head").isNull(), F.col("turn").asc_nulls_first(), "role", "text")
    return stream.mapInArrow(_replayed, f"conv long, {', '.join(f'{n} long' for n in _HEAD[:-1])}, audit string, repaired_sha256 string").withColumnRenamed("conv", id_col)
