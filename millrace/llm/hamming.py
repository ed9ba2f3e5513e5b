"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has the signs of its values as bits. Codes are cut into m
segments of about log2(n) bits. If two codes differ in at most m * (r + 1) - 1
bits, they differ in at most r bits of some segment; so after the codes with a
segment within radius r have been verified on all bits, every code that near is
known. The radius starts at 0 and grows by 1 for the queries whose k-th
verified distance is not yet covered, until none is left.

The index has a row for each part of about ``PART`` codes that share a segment
and a prefix of its value; parts with too many codes are dealt by a hash of the
code. A query visits the parts whose prefix is within its radius, and each visit
returns at most k + 1 codes per query; pairs are never emitted.

Different codes are searched once, whether as query or as answer: a code stands
for the k + 1 smallest ids that have it, which is all that any answer can need.

Cases with a defined result: null vectors have no code, are not found and find
nothing; null ids are not searched for and not found; null or NaN values have
bit 0; rows repeating id and code count once; a query does not find its own id;
equal distances go by id; with fewer than k others all are returned; vectors of
more than 64 values raise an error; empty tables give empty results; extra
columns are not read.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from millrace.functions.shipping import ship
from millrace.llm import common

BITS = 64
K = 10
#: Codes in a part of the index, and queries that visit a part together.
PART = 1 << 16
VISITORS = 1 << 18
SEED = 3
FOUND = "q long, code long, distance int, least long, ids int"


def sign_code(vector: Column) -> Column:
    """Bit i is set if value i is above 0."""
    bit = lambda x, i: F.when(x.isNotNull() & ~F.isnan(x) & (x > 0), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    code = F.aggregate(F.transform(vector.cast("array<double>"), bit), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
    return F.when(F.size(vector) <= BITS, code).otherwise(F.when(vector.isNotNull(), F.raise_error(F.lit(f"a code has at most {BITS} bits")).cast("long")))


def segments(n: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the segments for n codes."""
    m = max(1, min(16, round(BITS / max(4.0, np.log2(max(n, 2))))))
    edges = [BITS * i // m for i in range(m + 1)]
    return [(a, z - a) for a, z in zip(edges, edges[1:], strict=False)]


@lru_cache(maxsize=64)
def ring(width: int, radius: int) -> np.ndarray:
    """All values of ``width`` bits with ``radius`` bits set."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], np.uint64)


def segment_value(code: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(code, low).bitwiseAND(F.lit((1 << width) - 1)).cast("long")


def per_segment(rows: DataFrame, layout: list[tuple[int, int]], prefix_bits: int, *more: str) -> DataFrame:
    """``rows`` (code and ``more``) once for each segment, with seg and prefix."""
    each = F.array(*[F.struct(F.lit(j).alias("seg"), F.shiftright(segment_value(F.col("code"), low, width), max(0, width - prefix_bits)).alias("prefix")) for j, (low, width) in enumerate(layout)])
    return rows.select("code", *more, F.inline(each))


def _blobs(layout: list[tuple[int, int]], table: pa.Table) -> pa.Table:
    """One row for a part: its codes in the order of their segment's value, with least id and number of ids."""
    seg, prefix, salt = (table.column(c)[0].as_py() for c in ("seg", "prefix", "salt"))
    low, width = layout[seg]
    code = table.column("code").to_numpy().view(np.uint64)
    order = np.argsort((code >> np.uint64(low)) & np.uint64((1 << width) - 1), kind="stable")
    parts = [code[order].view(np.int64), table.column("least").to_numpy()[order], table.column("ids").to_numpy().astype(np.int64)[order]]
    return pa.table({"seg": pa.array([seg], pa.int32()), "prefix": [prefix], "salt": pa.array([salt], pa.int32()), "data": pa.array([np.concatenate(parts).tobytes()], pa.binary())})


def near_values(asked: np.ndarray, values: np.ndarray, width: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (asked, value) that differ in exactly ``radius`` bits; ``values`` ascend and differ."""
    masks = ring(width, radius)
    if len(masks) < len(values):
        at = [(np.minimum(np.searchsorted(values, asked ^ x), len(values) - 1), asked ^ x) for x in masks]
        hits = [(np.flatnonzero(values[i] == v), i) for i, v in at]
        return np.concatenate([h for h, _ in hits]), np.concatenate([i[h] for h, i in hits])
    return np.nonzero(np.bitwise_count(asked[:, None] ^ values) == radius)


def nearest(q: np.ndarray, distance: np.ndarray, least: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k first of each q by (distance, least)."""
    order = np.lexsort((least, distance, q))
    s = q[order]
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    nth = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
    return order[nth < k]


def _visit(layout: list[tuple[int, int]], radius: int, k: int):
    """Visits to a part by queries whose segment may differ in exactly ``radius`` bits: each takes its k + 1 nearest codes along."""
    names = ["q", "code", "distance", "least", "ids"]
    none = [np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int64, np.int32)]

    def visit(part: pa.Table, visitors: pa.Table) -> pa.Table:
        found = [none]
        if part.num_rows and visitors.num_rows:
            low, width = layout[part.column("seg")[0].as_py()]
            code, least, ids = np.frombuffer(part.column("data")[0].as_py(), np.int64).reshape(3, -1)
            code = code.view(np.uint64)
            value = (code >> np.uint64(low)) & np.uint64((1 << width) - 1)
            values, begin, size = np.unique(value, return_index=True, return_counts=True)
            asked = visitors.column("code").to_numpy().view(np.uint64)
            bound = visitors.column("bound").to_numpy()
            for at in range(0, len(asked), 64):
                q = asked[at : at + 64]
                a, v = near_values((q >> np.uint64(low)) & np.uint64((1 << width) - 1), values, width, radius)
                pair = np.repeat(a, size[v])
                inside = np.arange(len(pair)) - np.repeat(np.cumsum(size[v]) - size[v], size[v])
                other = np.repeat(begin[v], size[v]) + inside
                distance = np.bitwise_count(q[pair] ^ code[other]).astype(np.int32)
                close = distance <= bound[at : at + 64][pair]
                pair, other, distance = pair[close], other[close], distance[close]
                if len(pair):
                    best = nearest(pair, distance, least[other], k + 1)
                    found.append([q[pair[best]].view(np.int64), code[other[best]].view(np.int64), distance[best], least[other[best]], ids[other[best]].astype(np.int32)])
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=names)

    return visit


def search(rows: DataFrame, asked: DataFrame, k: int = K, part: int = PART) -> DataFrame:
    """(query_id, rank, vec_id, distance): for each (vec_id, code) of ``asked`` the k nearest of ``rows``."""
    spark = rows.sparkSession
    ship(spark)
    rows = rows.filter("vec_id IS NOT NULL AND code IS NOT NULL").select("vec_id", "code")
    few = F.row_number().over(W.partitionBy("code").orderBy("vec_id"))
    codes = rows.dropDuplicates().withColumn("nth", few).filter(F.col("nth") <= k + 1)
    codes = common.cut(codes.groupBy("code").agg(F.sort_array(F.collect_list("vec_id")).alias("all_ids")), "hamming-codes")
    n = codes.count()
    asked = common.cut(asked.filter("vec_id IS NOT NULL AND code IS NOT NULL").select("vec_id", "code").dropDuplicates(), "hamming-asked")
    layout = segments(n)
    bits = max(0, int(np.ceil(np.log2(max(1, n / part)))))
    placed = per_segment(codes.select("code", F.col("all_ids")[0].alias("least"), F.size("all_ids").alias("ids")), layout, bits, "least", "ids")
    sizes = common.cut(placed.groupBy("seg", "prefix").agg(F.ceil(F.count("*") / F.lit(2 * part)).cast("int").alias("salts")), "hamming-sizes")
    n_sizes = sizes.count()
    salt = F.pmod(F.xxhash64("code", F.lit(SEED)), F.col("salts")).cast("int").alias("salt")
    dealt = common.joined(placed, sizes, ["seg", "prefix"], "inner", n_sizes * 32).select("seg", "prefix", salt, "code", "least", "ids")

    def blobs(part: pa.Table) -> pa.Table:
        return _blobs(layout, part)

    index = dealt.groupBy("seg", "prefix", "salt").applyInArrow(blobs, "seg int, prefix long, salt int, data binary")
    index = common.cut(index, "hamming-index")

    active = common.cut(asked.select("code").distinct().withColumn("bound", F.lit(BITS)), "hamming-active")
    left = active.count()
    best = spark.createDataFrame([], FOUND)
    radius = 0
    while left:
        flips = [int(x) for d in range(min(radius, bits) + 1) for x in ring(bits, d)]
        visits = per_segment(active, layout, bits, "bound")
        visits = visits.withColumn("prefix", F.explode(F.transform(F.array(*[F.lit(x).cast("long") for x in flips]), lambda x: F.col("prefix").bitwiseXOR(x))))
        visits = common.joined(visits, sizes, ["seg", "prefix"], "inner", n_sizes * 32)
        chunk = F.pmod(F.xxhash64("code", F.lit(SEED + 1)), F.lit(-(-left // VISITORS))).cast("int").alias("chunk")
        visits = visits.select("seg", "prefix", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), chunk, "code", "bound")
        keys = ["seg", "prefix", "salt", "chunk"]
        visited = index.join(visits.select([F.col(c).alias(c) for c in keys]).distinct(), keys[:-1])
        found = visited.groupBy(keys).cogroup(visits.groupBy(keys)).applyInArrow(_visit(layout, radius, k), FOUND)
        order = W.partitionBy("q").orderBy("distance", "least")
        best = best.unionByName(found).dropDuplicates(["q", "code"])
        best = common.cut(best.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1).drop("nth"), "hamming-best")
        upto = best.withColumn("upto", F.sum("ids").over(order.rowsBetween(W.unboundedPreceding, 0)))
        kth = upto.filter(F.col("upto") > k).groupBy("q").agg(F.min("distance").alias("kth"))
        covered = len(layout) * (radius + 1) - 1
        if radius >= max(width for _, width in layout):
            break
        active = active.join(kth, F.col("code") == F.col("q"), "left").select("code", F.coalesce("kth", F.lit(BITS)).alias("bound"))
        active = common.cut(active.filter(F.col("bound") > covered), "hamming-active")
        left = active.count()
        radius += 1

    one = F.struct("distance", F.col("id").alias("vec_id"))
    each = best.join(codes, "code").select("q", "distance", F.explode("all_ids").alias("id"))
    each = each.withColumn("nth", F.row_number().over(W.partitionBy("q").orderBy("distance", "id"))).filter(F.col("nth") <= k + 1)
    lists = common.cut(each.groupBy("q").agg(F.sort_array(F.collect_list(one)).alias("near")), "hamming-lists")
    answers = common.joined(asked, lists, F.col("code") == F.col("q"), "inner", lists.count() * 16 * (k + 2))
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("vec_id")), 1, k)
    answers = answers.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("pos", "x"))
    return answers.select("query_id", (F.col("pos") + 1).alias("rank"), "x.vec_id", "x.distance")


def top_k(vectors: DataFrame, k: int = K) -> DataFrame:
    """Answers for every row of ``vectors`` (vec_id, embedding) whose id is divisible by 100, against all rows."""
    coded = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), sign_code(F.col("embedding")).alias("code"))
    coded = common.cut(coded.filter("vec_id IS NOT NULL AND code IS NOT NULL"), "hamming-rows")
    return search(coded, coded.filter("vec_id % 100 = 0"), k)


SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CAST(array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS BIT) AS code
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
d AS (
  SELECT q.vec_id AS query_id, v.vec_id, bit_count(xor(q.code, v.code))::INTEGER AS distance
  FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS rank, vec_id, distance FROM d)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""
