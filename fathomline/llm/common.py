"""Small helpers shared by the corpus operators: shared folders, Arrow batches and column hygiene."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Used only where a local session names no shared folder, as in tests.
LOCAL_SHARED = "/tmp/fathomline-shared"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a local master may leave it unset, a cluster may not."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    named = named or LOCAL_SHARED
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path that no other run uses, in a folder of the application's own that is removed when its JVM ends."""
    sc = spark.sparkContext
    own = f"{shared_dir(spark)}/fathomline-{sc.applicationId}"
    folder = sc._jvm.org.apache.hadoop.fs.Path(own)
    files = folder.getFileSystem(sc._jsc.hadoopConfiguration())
    if files.mkdirs(folder):
        files.deleteOnExit(folder)
    return f"{own}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder: later stages do not depend on executors staying alive."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, label: str) -> DataFrame:
    """As cut_lineage, but as a columnar, compressed table: for rows that hold arrays or texts."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold about ``most`` bytes each; a longer text stands alone."""
    for batch in batches:
        start, held = 0, 0
        sizes = text_sizes(batch.column(column))
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def give_back() -> None:
    """Returns memory that a task has freed to the system: its worker serves tasks of other stages, too, and what allocators keep adds up."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def text_sizes(texts: pa.Array):
    """UTF-8 bytes of each text, 0 for null."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)


def output(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    """A batch of the columns, cast to the schema."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, field.type, from_pandas=False) for c, field in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)


def kept_rows(docs: DataFrame, text_col: str, keep: Callable[[pa.Array], object], batch_bytes: int) -> DataFrame:
    """The rows, with all their columns, whose texts ``keep`` marks; it gets the texts of a batch and returns a mask."""
    from pyspark.sql import functions as F

    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    at = names.index(text_col)

    def filtered(batches):
        for batch in by_bytes(batches, f"c{at}", batch_bytes):
            yield batch.filter(pa.array(keep(batch.column(at)), pa.bool_()))
        give_back()

    return plain.mapInArrow(filtered, plain.schema).toDF(*names)
