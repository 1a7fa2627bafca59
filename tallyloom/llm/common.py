"""What the corpus operators share: reading tables, column-wise Python steps, cutting lineage, labelling components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus. Only Spark's reader touches the path.

    A small table may be one row group, which one core would read and work on: one of fewer partitions than there are
    cores is dealt out to all of them. Larger ones stay as they are read.
    """
    rows, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


class Remembered(dict):
    """A dictionary for a Python worker's lifetime, of at most `most` entries.

    When it is full, the first two thirds stay: what was met first is mostly what comes often.
    """

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def trim(self) -> None:
        """Call before entries are added."""
        if len(self) >= self.most:
            first = list(islice(self.items(), self.most * 2 // 3))
            self.clear()
            self.update(first)


def pieces(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about `most` bytes each, or one row."""
    sizes = np.full(batch.num_rows, 64, dtype=np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
            sizes += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // most, prepend=-1))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def map_lists(df: DataFrame, fn: Callable, schema: str | T.StructType) -> DataFrame:
    """Apply fn to small pieces of Arrow batches, given as one Python list per column of df; fn returns one list or Arrow array per output column.

    A batch that fails is run again with its partition, on any executor: fn keeps no state that matters.
    """
    out = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kinds = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b)):
            made = fn(*[c.to_pylist() for c in batch.columns])
            arrays = [m if isinstance(m, pa.Array) else pa.array(m, type=f.type) for m, f in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=kinds.names)

    return df.mapInArrow(run, out)


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that the cluster names in spark.checkpoint.dir. Where that is unset, one is made, if Spark runs on this machine alone."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


#: With it, shuffle files go as soon as the step that wrote them ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within it, steps remove their shuffle files at their end: for steps whose result is written and read from there on."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """df, checkpointed to the shared folder, so that lost executors cost no more than reading it; gone with the last reference to it."""
    shared_folder(df.sparkSession)
    with tidy(df.sparkSession):
        return df.checkpoint(eager=True)


class Scratch:
    """Compressed tables of one run in the shared folder, for large frames. They are emptied when their last reader is done."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def put(self, df: DataFrame) -> DataFrame:
        """df as it is read from its table."""
        self.paths.append(f"{shared_folder(self.spark)}/table-{uuid.uuid4().hex}")
        with tidy(self.spark):
            df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def clear(self) -> None:
        """Leave no rows in any of the tables. What still reads them must have been written elsewhere."""
        while self.paths:
            self.spark.range(0).write.mode("overwrite").parquet(self.paths.pop())


def crc_mod(column: str, n: int) -> Column:
    """crc32 of a column as text, modulo n; a null counts as empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(column).cast("string"), F.lit("")), "UTF-8")) % n


def sample_rows(df: DataFrame, key: str, most: int) -> DataFrame:
    """About `most` rows of df at most, chosen by a hash of key, the same ones in every run. For fitting models only."""
    n = df.select(key).count()
    if n <= most:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1_000_000)) < int(1_000_000 * most / n))


def components(edges: DataFrame) -> DataFrame:
    """Connected components: (node, component), component being the smallest node that can be reached.

    edges: columns a and b of an orderable type; repeated, reversed and self edges do no harm; nodes without an edge
    get no row. Rounds of linking each node's larger neighbours, then its smaller ones, to the least node around
    ("large star, small star"): about log2 of the longest chain's length. Each round ends in the checkpoint folder.
    A node with very many neighbours is a hot key of joins and of map-side-combined minima, which Spark splits.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs, before = cut(pairs), None
    while True:
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        pairs = cut(small.where("u <> v").distinct())
        # no node with two parents, and no parent that has one: every node then hangs at its component's least node
        state = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
