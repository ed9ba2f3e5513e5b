"""SimHash near-duplicates: fingerprints, links within a Hamming radius, components.

Candidates come from a segment-popcount embedding. A 64-bit fingerprint is cut
into 32 segments of two bits; the vector of their bit counts is at most as far
from another one in Manhattan distance as the fingerprints are in Hamming
distance. The 32 coordinates form G groups. Two vectors within distance 3
differ in at most 3 groups, so they agree on the G - 3 others: each vector is
filed in the grid cells of all choices of G - 3 groups, pairs that meet in a
cell pass the Manhattan bound first and are then verified on the full bits.

Work stays bounded in dense places: rows with equal fingerprints are one node;
a cell emits a spanning forest of its links, never all pairs; a cell with more
than ``DENSE`` fingerprints is split by exact bits, first on 3 of 6 blocks and
then on 13 of 16, where at most 4096 different fingerprints can meet.

Cases with a defined result: null and wordless texts have fingerprint zero and
link like any other; null ids are ignored by the minimum (a component of null
ids only has a null id); repeated rows each get their row; an empty table gives
an empty result; extra columns are not read, or passed through by ``dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.shipping import map_arrow
from millrace.llm import common

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Nodes from which 8 groups (cells of 5) replace 6 groups (cells of 3).
MANY_NODES = 1 << 26
DENSE = 2048
SLICE = 1 << 16
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
ODD_BITS = np.uint64(0x5555555555555555)


def shingle_hashes(words: list[bytes]) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles in order, in slices of bounded size."""
    import xxhash

    hashed = partial(xxhash.xxh64_intdigest, seed=SEED)
    if len(words) < SHINGLE:
        if words:
            yield np.array([hashed(b" ".join(words))], dtype=np.uint64)
        return
    for at in range(0, len(words) - SHINGLE + 1, SLICE):
        part = words[at : at + SLICE + SHINGLE - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        pieces = [joined[a:b] for a, b in zip(starts[: len(part) - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)]
        yield np.fromiter(map(hashed, pieces), np.uint64, len(pieces))


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes | None) -> int:
    """The 64-bit fingerprint of UTF-8 bytes: a bit is set if more than half of the shingle hashes have it."""
    n, counts = 0, np.zeros(64, np.int64)
    for hashes in shingle_hashes((text or b"").translate(LOWER).split()):
        n += len(hashes)
        counts += bit_counts(hashes)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0]) if n else 0


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rest = [i for i, name in enumerate(batch.schema.names) if name != "text"]
        texts = batch.column("text").cast(pa.binary())
        found = np.array([fingerprint(x.as_py()) for x in texts], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(found)], [*(batch.schema.names[i] for i in rest), "fp"])


def fingerprinted(rows: DataFrame) -> DataFrame:
    """``rows`` (text and others) with fp, a signed 64-bit fingerprint, in place of text."""
    kept = [f for f in rows.schema.fields if f.name != "text"]
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "fp long"])
    return map_arrow(rows, _fingerprints, out)


def thermometer(fp: np.ndarray) -> np.ndarray:
    """The popcount vector in unary code, two bits a segment: the Manhattan distance of two vectors is the Hamming distance of their codes."""
    hi = fp >> np.uint64(1)
    return ((fp | hi) & ODD_BITS) | ((fp & hi & ODD_BITS) << np.uint64(1))


def masks(parts: int, chosen: int, unit: int = 2) -> list[np.uint64]:
    """Bit masks of every choice of ``chosen`` of ``parts`` ranges of whole ``unit``-bit segments."""
    edges = [round(64 / unit * i / parts) * unit for i in range(parts + 1)]
    spans = [sum(1 << b for b in range(a, z)) for a, z in zip(edges, edges[1:], strict=False)]
    return [np.uint64(sum(c)) for c in combinations(spans, chosen)]


def mixed_key(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 1) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _cells(groups: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chosen = masks(groups, groups - RADIUS)
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        code = thermometer(fp)
        for salt, mask in enumerate(chosen):
            yield pa.RecordBatch.from_arrays([pa.array(mixed_key(code & mask, salt).view(np.int64)), pa.array(fp.view(np.int64))], ["cell", "fp"])


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether fingerprints are within the radius: Manhattan bound first, then the bits."""
    ok = np.bitwise_count(thermometer(a) ^ thermometer(b)) <= RADIUS
    if ok.any():
        ok &= np.bitwise_count(a ^ b) <= RADIUS
    return ok


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n nodes over the links (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def links_within(fp: np.ndarray, depth: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of different fingerprints, as index pairs."""
    n = len(fp)
    if n <= DENSE or depth == 2:
        found = []
        for i in range(0, n, 256):
            x, y = np.nonzero(near(fp[i : i + 256, None], fp[None, i:]))
            keep = x < y
            found.append(np.stack((x[keep] + i, y[keep] + i)))
        a, b = np.concatenate(found, axis=1)
    else:
        pairs = []
        for mask in masks(6, 3, 1) if depth == 0 else masks(16, 13, 1):
            key = fp & mask
            order = np.argsort(key, kind="stable")
            for s, e in zip(*runs(key[order]), strict=True):
                if e - s > 1:
                    at = order[s:e]
                    x, y = links_within(fp[at], depth + 1)
                    pairs.append(np.stack((at[x], at[y])))
        a, b = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
    root = forest(n, a, b)
    a = np.flatnonzero(root != np.arange(n))
    return a, root[a]


def cell_links(cell: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within the runs of equal ``cell``; small cells go together by their lags, large ones one by one."""
    starts, ends = runs(cell)
    size = ends - starts
    found_a, found_b = [], []
    small = np.repeat(np.where((size > 1) & (size <= 16), size, 0), size)
    for lag in range(1, 16):
        at = np.flatnonzero((small[:-lag] > lag) & (cell[:-lag] == cell[lag:])) if len(cell) > lag else np.zeros(0, np.int64)
        if not len(at):
            break
        at = at[near(fp[at], fp[at + lag])]
        found_a.append(fp[at])
        found_b.append(fp[at + lag])
    for s, e in zip(starts[size > 16].tolist(), ends[size > 16].tolist(), strict=True):
        a, b = links_within(fp[s:e])
        found_a.append(fp[s:e][a])
        found_b.append(fp[s:e][b])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *found_a]), np.concatenate([none, *found_b])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by cell: links, each once per call; the last, perhaps unended, cell of a batch waits for the next."""
    cell, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def found(c: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        a, b = cell_links(c, f)
        pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].view(np.int64)), pa.array(pairs[:, 1].view(np.int64))], ["a", "b"])

    waiting = []
    for batch in batches:
        if not batch.num_rows:
            continue
        c = batch.column("cell").to_numpy(zero_copy_only=False)
        f = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        waiting.append((c, f))
        if waiting[0][0][0] == c[-1]:  # one cell so far
            continue
        cell, fp = (np.concatenate(x) for x in zip(*waiting, strict=True))
        last = int(np.searchsorted(cell, cell[-1]))
        yield found(cell[:last], fp[:last])
        waiting = [(cell[last:], fp[last:])]
    if waiting:
        yield found(*(np.concatenate(x) for x in zip(*waiting, strict=True)))


def near_links(nodes: DataFrame, n: int) -> DataFrame:
    """(a, b) links between the n different fingerprints of ``nodes``; every component of the full link graph is connected by them."""
    groups = 8 if n >= MANY_NODES else 6
    cells = map_arrow(nodes.select("fp"), partial(_cells, groups), "cell long, fp long")
    return map_arrow(cells.repartition("cell").sortWithinPartitions("cell"), _links, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of ``links``; alternating large-star and small-star rounds."""

    def star(edges: DataFrame, low: bool, n: int) -> DataFrame:
        """Points the neighbours of each node (the larger ones, or the smaller ones and itself) at its smallest neighbour."""
        both = edges if low else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        out = common.looked_up(both, lowest, "u", 2 * n)
        if low:
            out = out.select("v", "m").unionByName(lowest.select(F.col("u").alias("v"), "m"))
        else:
            out = out.filter("v > u").select("v", "m")
        return out.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()

    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    before, n, spark = None, links.count(), links.sparkSession
    with common.scratch(spark) as made:
        while True:
            # neither star makes more edges than the nodes and edges before it
            edges = common.cut(star(star(edges, low=False, n=n), low=True, n=2 * n), "stars")
            state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if state == before:
                made.pop()
                return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            before, n = state, state[0]
            for path in made[:-1]:  # the round before is read by nothing any more
                common.delete(spark, path)
            del made[:-1]


def component_of(rows: DataFrame, best: str) -> DataFrame:
    """(fp, best, n): for every fingerprint of ``rows`` the smallest ``best`` in its component, and the rows that have it."""
    nodes = common.cut(rows.groupBy("fp").agg(F.min(best).alias(best), F.count("*").alias("n")), "simhash-nodes")
    total = nodes.count()
    links = common.cut(near_links(nodes, total), "simhash-links")
    if links.isEmpty():
        return nodes
    roots = components(links.select("a", "b"))
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    linked = common.cut(nodes.join(roots, nodes.fp == roots.node).select("fp", "root", best), "simhash-roots")
    lowest = linked.groupBy("root").agg(F.min(best).alias("low"), F.count("*").alias("n"))
    low = common.looked_up(linked, lowest, "root", total).select(F.col("fp").alias("node"), "low")
    return nodes.join(low, nodes.fp == low.node, "left").select("fp", F.when(F.col("node").isNull(), F.col(best)).otherwise(F.col("low")).alias(best), "n")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``."""
    rows = common.cut(fingerprinted(docs.select("doc_id", "text")), "simhash-rows")
    best = component_of(rows, "doc_id").withColumnRenamed("doc_id", "component_id")
    rows = common.looked_up(rows, best, "fp", rows.count())
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup(docs: DataFrame) -> DataFrame:
    """One row of each component, all its columns: the one with the smallest doc_id, null last.

    Rows are known by doc_id and a digest of the text, which another scan finds
    again, however its files are split. Of rows that share both, the one with
    the least JSON form stays. Only fingerprints are written, never documents.
    """
    rows = docs.select(F.struct("*").alias("d")).select("d", "d.doc_id", F.coalesce("d.text", F.lit("")).alias("text"))
    rows = rows.select("d", "doc_id", "text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"))
    keys = fingerprinted(rows.select("doc_id", "digest", "text")).groupBy("doc_id", "digest", "fp").agg(F.count("*").alias("rows"))
    keys = common.cut(keys, "simhash-rows").withColumn("own", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest"))
    best = component_of(keys.select("fp", F.col("own").alias("best")), "best")
    known = common.looked_up(keys, best, "fp", keys.count())
    stays = F.col("own").eqNullSafe(F.col("best"))
    apart = common.cut(known.filter(~stays | (F.col("rows") > 1)).select("doc_id", "digest", stays.alias("stays")), "simhash-gone")
    n_gone, n_many = apart.agg(F.count_if(~F.col("stays")), F.count_if("stays")).first()
    same = F.expr("a.doc_id <=> b.doc_id AND a.digest = b.digest")
    rows = rows.drop("text").alias("a")
    kept = common.joined(rows, apart.alias("b"), same, "left_anti", (n_gone + n_many) * 32).select("d.*")
    if n_many:
        many = common.joined(rows, apart.filter("stays").alias("b"), same, "left_semi", n_many * 32)
        kept = kept.unionByName(many.groupBy("doc_id", "digest").agg(F.min_by("d", F.to_json("d")).alias("d")).select("d.*"))
    return kept
