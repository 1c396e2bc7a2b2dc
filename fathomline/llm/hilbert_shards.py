"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised by quantiles over all rows (numbers by approximate ones; strings by exact
ones of their whole values, ranked in byte order with their counts), the cell's index on the Hilbert curve is computed, rows are
range-partitioned and sorted by it, and the order is cut into runs of equal row counts. Neighbours on
the curve share value ranges in every dimension, so a shard's min/max statistics prune by any of them.

Only ids, sizes and metadata are shuffled for the assignment. Ties on the curve are broken by id,
text hash and input position, so neither one hot value nor repeated rows pile up in one range. The
driver sees one count a range, and of a string dimension the values at its cuts.

Nulls form the lowest quantum of a dimension; null text has size 1. Repeated rows each get a place;
an empty table gives an empty table; extra columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written


def curve_index(cells: list[np.ndarray], bits: int) -> np.ndarray:
    """Index on the Hilbert curve of integer cells of the given bits a dimension (Skilling's transposed form, over whole arrays)."""
    x = [c.astype(np.int64).copy() for c in cells]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << 1) | (((x[i] ^ turn) >> b) & 1)
    return index


def string_edges(lean: DataFrame, name: str, bits: int) -> list[str]:
    """The values at the 2**bits - 1 cuts of a string column, in byte order; only distinct values are sorted."""
    spark = lean.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = lean.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    ranges = written(counts.repartitionByRange(parts, name).withColumn("range", F.spark_partition_id()), "shard-values")
    before, total = [], 0
    for r in sorted(ranges.groupBy("range").agg(F.sum("n").alias("n")).collect(), key=lambda r: r["range"]):
        before.append((r["range"], total))
        total += r["n"]
    offsets = spark.createDataFrame(before, "range int, before long")
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("range").orderBy(name).rowsBetween(Window.unboundedPreceding, 0))
    cuts = lambda rank: F.least(F.floor(rank * (1 << bits) / max(total, 1)), F.lit((1 << bits) - 1))
    ranked = ranges.join(F.broadcast(offsets), "range").withColumn("upto", upto)
    return [r[0] for r in ranked.where(cuts(F.col("upto")) > cuts(F.col("upto") - F.col("n"))).orderBy("upto").select(name).collect()]


def _below(column: Column, edges: list[str]) -> Column:
    """How many of the edges are smaller than the value; none for null."""
    below = F.filter(F.array(*[F.lit(e) for e in edges]).cast("array<string>"), lambda e: e < column)
    return F.when(column.isNull(), 0).otherwise(F.size(below)).cast("double")


def shard_rows(docs: DataFrame, dimensions: list[Column | str], shards: int, id_col: str = "doc_id", text_col: str = "text", bits: int = 5, accuracy: int = 1000, row_col: str | None = None) -> DataFrame:
    """(id, size, text_crc32, shard, slot, curve) of each row; shards differ by one row at most.

    bits: a dimension is cut into at most 2**bits quanta; accuracy: of the quantiles' sketch; row_col: a
    column that numbers the rows and is returned with them (their position in the input breaks ties without it).
    """
    spark = docs.sparkSession
    named = [docs[d] if isinstance(d, str) else d for d in dimensions]
    probe = docs.select(*[c.alias(f"d{i}") for i, c in enumerate(named)])
    values = [(c if kind == "string" else c.cast("double")).alias(f"d{i}") for i, (c, (_, kind)) in enumerate(zip(named, probe.dtypes, strict=True))]
    text = docs[text_col].cast("string")
    lean = docs.select(
        docs[id_col].cast("long").alias("key"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).cast("long").alias("crc"), *values, (docs[row_col] if row_col else F.monotonically_increasing_id()).alias("row"),
    )
    lean = written(lean, "shard-rows")  # the texts are read and hashed once
    at = [k / (1 << bits) for k in range(1, 1 << bits)]
    names = [f"d{i}" for i in range(len(values))]
    texts = [n for n, kind in probe.dtypes if kind == "string"]
    cuts = lean.agg(F.count(F.lit(1)), *[F.percentile_approx(n, at, accuracy).alias(n) for n in names if n not in texts]).first()
    # a string comes to the curve as its quantum already, which these edges leave as it is
    edges = [list(range(1 << bits)) if n in texts else sorted({v for v in (cuts[n] or []) if v == v}) for n in names]
    quanta = [_below(F.col(n), string_edges(lean, n, bits)).alias(n) if n in texts else F.col(n) for n in names]

    @F.pandas_udf("long")
    def curve(values: pd.DataFrame) -> pd.Series:
        cells = []
        for name, edge in zip(names, edges, strict=True):
            v = values[name].to_numpy(np.float64)
            cells.append(np.where(np.isnan(v), 0, np.searchsorted(np.asarray(edge, np.float64), v, side="left") if edge else 0))
        return pd.Series(curve_index(cells, bits))

    keys = ["curve", "key", "crc", "row"]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = lean.select("key", "size", "crc", "row", curve(F.struct(*quanta)).alias("curve"))
    ordered = placed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("range", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    ordered = written(ordered, "shard-order")  # ranks stay as they are, whatever is read from here again
    counts = sorted((r["range"], r["n"]) for r in ordered.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect())
    before, total = [], 0
    for number, n in counts:
        before.append((number, total))
        total += n
    offsets = spark.createDataFrame(before, "range int, before long")
    rank = F.col("before") + F.col("place")
    # the first total % shards shards hold one row more
    small, more = divmod(total, shards)
    edge = more * (small + 1)
    shard = F.when(rank < edge, F.floor(rank / (small + 1))).otherwise(more + F.floor((rank - edge) / max(small, 1)))
    first = F.col("shard") * small + F.least(F.col("shard"), F.lit(more))
    out = ordered.join(F.broadcast(offsets), "range").withColumn("rank", rank).withColumn("shard", shard.cast("int"))
    slot = (F.col("rank") - first).cast("long").alias("slot")
    return out.select(F.col("key").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", slot, "curve", *([F.col("row").alias(row_col)] if row_col else []))


def write_shards(docs: DataFrame, path: str, dimensions: list[Column | str], shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the rows, whole and each once, under path/shard=N/ in curve order; returns the assignment.

    Rows are told apart by a number of their own, so ids may repeat or be null. A column named ``shard`` gives way to the shard's number.
    """
    names = docs.columns
    plain = docs.select(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(names)], *[(docs[d] if isinstance(d, str) else d).alias(f"d{i}") for i, d in enumerate(dimensions)])
    tagged = written(plain.withColumn("row", F.monotonically_increasing_id()), "shard-docs")
    placed = written(shard_rows(tagged, [f"d{i}" for i in range(len(dimensions))], shards, f"c{names.index(id_col)}", f"c{names.index(text_col)}", row_col="row"), "shard-plan")
    own = [c for c in tagged.columns if c.startswith("c")]
    rows = tagged.select("row", *own).join(placed.select("row", "shard", "slot"), "row")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(max(parts, shards), "shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.select(*[F.col(c).alias(n) for c, n in zip(own, names, strict=True) if n != "shard"], "shard").write.partitionBy("shard").parquet(path)
    return placed.drop("row").withColumnRenamed(f"c{names.index(id_col)}", id_col)
