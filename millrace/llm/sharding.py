"""Shuffled shards by a two-pass external shuffle.

Pass one scatters rows by seeded hashes: the shard is the rendezvous choice of
doc_id (so one more shard takes rows only into itself: law ``key``), and within
a shard the row falls into one of many buckets of about ``BUCKET_BYTES``. Pass
two takes one bucket at a time into memory, shuffles it (numpy's permutation
is the Fisher-Yates algorithm) with a generator seeded by shard and bucket, and writes it; a
row's slot is its bucket's offset in the shard plus its place in the bucket.

Buckets are sized from a first count over all rows. Where one doc_id repeats so
often that a bucket would outgrow memory, the scatter also hashes the row's
position in its input, so the repeats spread over the buckets of their shard.

Cases with a defined result: null text has one byte (the size adds 1) and is
written as null; null doc_id is a key like any other; repeated rows all get
slots of their own; empty tables give empty shards; extra columns are carried
into the shards by ``write_shards`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from millrace.functions.shipping import map_arrow
from millrace.llm import common

SHARDS = 16
BUCKET_BYTES = 32 << 20
GRANULES = 1 << 16
#: Tasks of the second pass at most; beyond, a task takes several buckets one after another.
MAX_TASKS = 1 << 16
SEED = 20240607
LAW = "key"
EMIT_BYTES = 4 << 20


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text plus 1; null has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def rendezvous(key: Column, shards: int) -> tuple[Column, Column]:
    """The shard of ``key`` among ``shards`` and among one more."""
    draws = [F.struct(F.xxhash64(key, F.lit(s), F.lit(SEED)).alias("h"), F.lit(s).alias("s")) for s in range(shards + 1)]
    return F.array_max(F.array(*draws[:-1]))["s"], F.array_max(F.array(*draws))["s"]


def _shuffled(columns: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (shard, bucket); each bucket leaves in a new order, with ``slot``."""
    waiting: list[pa.Table] = []

    def emit(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        table = pa.concat_tables(parts)
        shard, bucket, offset = (table.column(c)[0].as_py() for c in ("shard", "bucket", "offset"))
        order = np.random.default_rng([SEED, shard, bucket]).permutation(table.num_rows)
        step = max(1, int(table.num_rows * EMIT_BYTES / max(table.nbytes, 1)))
        for at in range(0, table.num_rows, step):
            part = table.take(pa.array(order[at : at + step]))
            slots = pa.array(np.arange(at, at + part.num_rows) + offset, pa.int64())
            yield from pa.table([*(part.column(c) for c in columns), slots], [*columns, "slot"]).combine_chunks().to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("shard").to_numpy().astype(np.int64) << 40 | batch.column("bucket").to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        table = pa.Table.from_batches([batch])
        for i, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
            new = i or not waiting or (waiting[-1].column("shard")[-1].as_py() << 40 | waiting[-1].column("bucket")[-1].as_py()) != key[s]
            if new and waiting:
                yield from emit(waiting)
                waiting = []
                pa.default_memory_pool().release_unused()  # two workers share an executor's memory with its JVM
            waiting.append(table.slice(s, e - s))
    if waiting:
        yield from emit(waiting)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Writes ``docs`` (doc_id, text and others) to ``path``/shard=N as Parquet rows (d, shard, grown_shard, slot), each task's rows in slot order."""
    shard, grown = rendezvous(F.col("d.doc_id"), shards)
    rows = docs.select(F.struct("*").alias("d")).select(
        "d", shard.alias("shard"), grown.alias("grown_shard"), text_size(F.col("d.text")).alias("size"), text_crc32(F.col("d.text")).alias("crc"),
    )
    at = F.xxhash64(F.lit(SEED), "d.doc_id", "crc")
    limit = 4 * bucket_bytes
    for again in (False, True):
        placed = rows.withColumn("granule", F.pmod(F.xxhash64(at, F.monotonically_increasing_id()) if again else at, F.lit(GRANULES)).cast("int"))
        if again:
            # counted and placed from one written table: another scan could number the rows anew
            placed = common.cut(placed, "scattered")
        granules = common.cut(placed.groupBy("shard", "granule").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "granules")
        total, most = granules.agg(F.sum("bytes"), F.max("bytes")).first()
        if (most or 0) <= max(limit, 4 * (total or 0) // (shards * GRANULES)):
            break
    buckets = min(GRANULES, max(1, -(-(total or 0) // (shards * bucket_bytes))))
    bucket = F.floor(F.col("granule") * F.lit(buckets) / GRANULES).cast("long").alias("bucket")
    sums = granules.groupBy("shard", bucket).agg(F.sum("n").alias("n"))
    offset = (F.sum("n").over(W.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("offset")
    offsets = common.cut(sums.select("shard", "bucket", offset), "offsets")
    # as many tasks as buckets, twice as hashes collide: a number left to the session would put many buckets into one task
    tasks = min(2 * shards * buckets, MAX_TASKS)
    placed = placed.select("d", "shard", "grown_shard", "size", "crc", bucket).repartition(tasks, "shard", "bucket")
    placed = common.joined(placed, offsets, ["shard", "bucket"], "inner", shards * buckets * 48)
    placed = placed.select("shard", "bucket", "offset", "grown_shard", "size", "crc", "d").sortWithinPartitions("shard", "bucket", "d.doc_id", "crc", "size").drop("size", "crc")
    columns = ["d", "shard", "grown_shard"]
    out = T.StructType([placed.schema[c] for c in columns] + [T.StructField("slot", T.LongType())])
    map_arrow(placed, partial(_shuffled, columns), out).write.partitionBy("shard").parquet(path)


def sharded(docs: DataFrame) -> DataFrame:
    """Writes the shards below the shared folder and reads them back: (doc_id, size, text_crc32, law, shard, slot, grown_shard) by row."""
    spark = docs.sparkSession
    path = common.shared_path(spark, "shards")
    docs = docs.select("doc_id", "text")
    write_shards(docs, path)
    d = T.StructField("d", docs.schema)
    schema = T.StructType([d, T.StructField("grown_shard", T.IntegerType()), T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])
    if not docs.isEmpty():
        back = spark.read.schema(schema).parquet(path)
    else:
        back = spark.createDataFrame([], schema)
    text = F.col("d.text")
    return back.select("d.doc_id", text_size(text).alias("size"), text_crc32(text).alias("text_crc32"), F.lit(LAW).alias("law"), "shard", "slot", "grown_shard")
