"""Removal of long repeated byte strings, decided by suffix arrays.

Every byte that lies in a ``LENGTH``-byte string which also starts earlier (in
a document before it, or further left in its own) is removed. Texts are UTF-8
bytes; no string crosses documents; what repeats is judged on the input.

1. Whole copies: texts are grouped by SHA-256, only the first of a group goes
   on, the others are removed as a whole if they have ``LENGTH`` bytes.
2. Runs: the smallest ``GRAM``-gram hash in a window of LENGTH bytes is a
   function of the window's bytes, so equal windows have equal smallest hashes
   wherever they are. Consecutive windows with one such key are a run. Only
   runs whose key is met twice, or that repeat themselves, can hold repeats. Each batch counts its own keys
   and sends one row per key, so the rows of a frequent key are as many as the
   batches that have it; its other runs are known to be shared and pass by.
3. The texts of shared runs meet by key. Equal run texts are one, and of the
   different ones a block at a time gets a suffix array: suffixes smaller than
   their successors are sorted directly, to the depth LENGTH, the others are
   induced by bucket scans, and neighbours with a common prefix of LENGTH bytes
   are one class, of which the earliest window stays. Runs of keys with more
   than ``HOT`` runs go window by window under the hash of the window instead,
   so that no key is heavy at this step.
4. Removed windows come together by document, and the text is cut.

Cases with a defined result: null and empty texts have no bytes and stay as
they are (null stays null in ``dedup``); the first document is that with the
smallest doc_id, null before all, and among different texts with equal doc_id
that with the smaller xxhash64; of rows repeating doc_id and text one is first;
an empty table gives an empty result; extra columns are not read, or are passed
on by ``dedup`` whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from millrace.functions.shipping import map_arrow
from millrace.llm import common

LENGTH = 100
#: Bytes of a hashed gram; a window holds GRAMS of them.
GRAM = 32
GRAMS = LENGTH - GRAM + 1
#: Window starts hashed at once, bytes of text in one suffix array, runs of a key that is split by window.
SEGMENT = 1 << 19
BLOCK = 1 << 20
HOT = 4096
#: From so many windows a run is first freed of its own repeats.
LONG_RUN = 256
SEED = 7
MULTIPLIER = 0xD6E8FEB86659FD93
NO_ID = -(1 << 63)
RUN = "key long, id long, c long, start int, n int, local int"
SHARED = "key long, id long, c long, start int, n int, total long"
PIECE = "key long, id long, c long, start int, n int, piece binary"
SPAN = "id long, c long, s int, e int"


# ---- keys of windows


@cache
def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of bytes, and powers of the multiplier and of its inverse modulo 2**64."""
    values = np.random.default_rng(SEED).integers(0, 1 << 63, 256).astype(np.uint64)

    def powers(x: int) -> np.ndarray:
        out = np.full(n, x, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return values, powers(MULTIPLIER), powers(pow(MULTIPLIER, -1, 1 << 64))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each GRAM bytes of ``data``, by prefix sums."""
    n = len(data)
    values, up, down = _tables(SEGMENT + LENGTH)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values[data] * up[:n], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(MULTIPLIER)
    h ^= h >> np.uint64(29)
    return h


def window_keys(low: np.ndarray) -> np.ndarray:
    """The smallest of the gram hashes in each LENGTH-byte window."""
    width = 1
    while width < GRAMS:
        step = min(width, GRAMS - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    return low


def recurring(hashes: np.ndarray) -> np.ndarray:
    """Places of some grams that come again within GRAMS bytes: one at least for any two equal windows that close."""
    rows = -(-len(hashes) // GRAMS)
    padded = np.concatenate((hashes, np.zeros((rows + 1) * GRAMS - len(hashes), np.uint64)))
    near = np.lib.stride_tricks.as_strided(padded, (rows, GRAMS), (8 * GRAMS, 8))
    return np.flatnonzero((near[:, 1:] == near[:, :1]).any(axis=1)) * GRAMS


def runs_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, position, windows, whether it may repeat itself) of the runs in the ascending texts data[starts[i]:ends[i]]."""
    keys, places, counts, twice = [], [], [], []
    for at in range(int(starts[0]), int(ends[-1]) - LENGTH + 1, SEGMENT) if len(starts) else ():
        part = data[at : at + SEGMENT + LENGTH - 1]
        first, last = np.searchsorted(ends, at, "right"), np.searchsorted(starts, at + len(part), "left")
        step = np.zeros(len(part) - LENGTH + 2, np.int8)
        a = np.clip(starts[first:last] - at, 0, len(step) - 1)
        z = np.clip(ends[first:last] - LENGTH + 1 - at, 0, len(step) - 1)
        some = a < z
        step[a[some]] += 1
        np.subtract.at(step, z[some], 1)
        whole = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
        if not whole.any():
            continue
        hashes = gram_hashes(part)
        key = window_keys(hashes)
        new = whole.copy()
        new[1:] &= ~whole[:-1] | (key[1:] != key[:-1])
        end = whole.copy()
        end[:-1] &= ~whole[1:] | (key[1:] != key[:-1])
        s = np.flatnonzero(new)
        n = np.flatnonzero(end) - s + 1
        again = recurring(hashes)
        keys.append(key[s])
        places.append(s + at)
        counts.append(n)
        twice.append((n > GRAMS) | (np.searchsorted(again, s + n + GRAMS - 1) > np.searchsorted(again, s)))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate(keys), np.concatenate(places), np.concatenate(counts), np.concatenate(twice)


def text_buffer(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and where each value begins (and the last one ends)."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8), offsets


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal values in sorted ``keys``."""
    starts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
    return starts, np.diff(np.append(starts, len(keys)))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = text_buffer(batch.column("text"))
        ids, c = (batch.column(x).to_numpy() for x in ("id", "c"))
        if not len(ids):
            continue
        order = np.lexsort((ids, c))
        own = np.ones(len(ids), bool)  # of equal texts the first document only
        own[order[1:]] = c[order[1:]] != c[order[:-1]]
        own &= np.diff(at) >= LENGTH
        key, place, n, twice = runs_of(data, at[:-1][own], at[1:][own])
        if not len(key):
            continue
        doc = np.searchsorted(at, place, "right") - 1
        order = np.argsort(key, kind="stable")
        first, size = groups(key[order])
        local = np.zeros(len(key), np.int32)
        local[order[first]] = np.where(np.maximum.reduceat(twice[order], first), np.maximum(size, 2), size)
        arrays = [key.view(np.int64), ids[doc], c[doc], (place - at[doc]).astype(np.int32), n.astype(np.int32), local]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["key", "id", "c", "start", "n", "local"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From run rows sorted by key: those of keys met twice; the last key of a batch waits for the next batch."""
    names = ["key", "id", "c", "start", "n", "local"]

    def found(rows: list[np.ndarray]) -> pa.RecordBatch:
        key, ids, c, start, n, local = rows
        first, size = groups(key)
        met = (np.minimum.reduceat(c, first) != np.maximum.reduceat(c, first)) | np.maximum.reduceat(local != 1, first)
        keep = np.repeat(met, size)
        total = np.repeat(np.add.reduceat(local.astype(np.int64), first), size)
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, ids, c, start, n, total)], [*names[:-1], "total"])

    waiting: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(x).to_numpy() for x in names]
        waiting.append(rows)
        if waiting[0][0][0] == rows[0][-1]:
            continue
        joined = [np.concatenate(x) for x in zip(*waiting, strict=True)]
        last = int(np.searchsorted(joined[0], joined[0][-1]))
        yield found([x[:last] for x in joined])
        waiting = [[x[last:] for x in joined]]
    if waiting:
        yield found([np.concatenate(x) for x in zip(*waiting, strict=True)])


# ---- the suffix array


def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """Whether each suffix of ``t`` is smaller than the one that begins after it (the empty one is the smallest)."""
    n = len(t)
    step = np.empty(n, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int16) - t[:-1])
    step[-1] = -1
    at = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def sorted_directly(t: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes ``at`` of ``t`` in the order of their first ``depth`` bytes, refined a word at a time where they tie."""
    padded = np.concatenate((t, np.zeros(depth + 16, np.uint8)))
    word = np.lib.stride_tricks.as_strided(padded, (len(t) + depth + 8, 8), (1, 1)).copy().view(">u8").ravel().astype(np.uint64)
    key = word[at]
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    tie = key[1:] == key[:-1]  # whether each suffix ties with the one before it
    done = 8
    while done < depth and tie.any():
        tied = np.zeros(len(at), bool)
        tied[1:] |= tie
        tied[:-1] |= tie
        where = np.flatnonzero(tied)
        new = np.ones(len(where), bool)
        new[1:] = ~tie[where[1:] - 1]
        group = np.cumsum(new).astype(np.uint64)
        taken = (64 - int(group[-1]).bit_length()) // 8
        bits = np.uint64(8 * taken)
        key = (group << bits) | (word[at[where] + done] >> (np.uint64(64) - bits))
        order = np.argsort(key, kind="stable")
        at[where] = at[where][order]
        key = key[order]
        same = np.zeros(len(at), bool)
        same[where[1:]] = key[1:] == key[:-1]
        tie = same[1:]
        done += taken
    return at


def suffix_array(t: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """The suffixes of ``t`` ordered by their first ``depth`` bytes, by two-stage sorting."""
    small = smaller_than_next(t)
    direct = sorted_directly(t, np.flatnonzero(small), depth)
    edge = np.searchsorted(t[direct], np.arange(257))
    placed: list[list[np.ndarray]] = [[] for _ in range(256)]
    placed[t[-1]].append(np.array([len(t) - 1]))
    out = []
    for c in range(256):
        parts, now = placed[c], np.concatenate([np.zeros(0, np.int64), *placed[c]])
        while len(now := now[now > 0] - 1) and len(now := now[t[now] == c]):  # runs of this byte
            parts.append(now)
        bucket = np.concatenate([np.zeros(0, np.int64), *parts, direct[edge[c] : edge[c + 1]]])
        placed[c] = []
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[t[before] > c]
        if len(before):
            byte = t[before]
            order = np.argsort(byte, kind="stable")
            before, byte = before[order], byte[order]
            first, size = groups(byte)
            for s, k in zip(first.tolist(), size.tolist(), strict=True):
                placed[byte[s]].append(before[s : s + k])
    return np.concatenate(out)


def common_prefixes(t: np.ndarray, array: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether each suffix of the array has ``length`` bytes in common with the one before it (False for the first)."""
    padded = np.concatenate((t, np.zeros(length + 8, np.uint8)))
    word = np.lib.stride_tricks.as_strided(padded, (len(t) + length, 8), (1, 1)).copy().view(np.uint64).ravel()
    alike = np.arange(1, len(array))
    for d in [*range(0, length - 8, 8), length - 8]:
        alike = alike[word[array[alike] + d] == word[array[alike - 1] + d]]
    out = np.zeros(len(array), bool)
    out[alike] = True
    return out


def repeated_windows(texts: list[bytes], n: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Over the concatenated ``texts``: whether the window at each byte also is at a lower rank.

    Text i has n[i] windows, of rank[i], rank[i] + 1 and so on; all ranks differ.
    """
    t = np.frombuffer(b"".join(texts), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(size) - size
    inside = np.arange(len(t)) - np.repeat(begin, size)
    ranks = np.where(inside < np.repeat(n, size), np.repeat(rank, size) + inside, np.iinfo(np.int64).max)
    array = suffix_array(t)
    first, count = groups(np.cumsum(~common_prefixes(t, array)))
    ordered = ranks[array]
    out = np.zeros(len(t), bool)
    out[array] = ordered > np.repeat(np.minimum.reduceat(ordered, first), count)
    out &= inside < np.repeat(n, size)
    return out


# ---- texts of runs, and the spans to remove


def distinct_windows(text: bytes, n: int) -> list[tuple[int, int, bool]]:
    """(first window, windows, new) in order: stretches of windows that are new in this run or repeat an earlier one of it."""
    seen: set[bytes] = set()
    out: list[tuple[int, int, bool]] = []
    for i in range(n):
        w = text[i : i + LENGTH]
        new = w not in seen
        if new:
            seen.add(w)
        if out and out[-1][2] == new:
            out[-1] = (out[-1][0], out[-1][1] + 1, new)
        else:
            out.append((i, 1, new))
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of shared runs, equal ones of a batch once; a row without text is a run to remove."""
    import xxhash

    for batch in batches:
        ids, cs = batch.column("id").to_pylist(), batch.column("c").to_pylist()
        best: dict[tuple[int, bytes], tuple[int, int, int, int]] = {}
        gone: list[tuple[int, int, int, int]] = []

        def put(key: int, text: bytes, row: tuple[int, int, int, int]) -> None:
            old = best.setdefault((key, text), row)
            if old != row:  # else it is this row, or a repeated row of the table
                if row < old:
                    best[key, text], row = row, old
                gone.append(row)

        spots = batch.column("spots")
        edges = spots.offsets.to_pylist()
        starts, counts, keys, hot = (spots.values.field(x).to_pylist() for x in ("start", "n", "key", "hot"))
        for doc, text in enumerate(batch.column("text")):
            text = text.as_py()
            i, c = ids[doc], cs[doc]
            for r in range(edges[doc], edges[doc + 1]):
                start, n, key = starts[r], counts[r], keys[r]
                piece = text[start : start + n + LENGTH - 1]
                for at, k, new in distinct_windows(piece, n) if n >= LONG_RUN else ((0, n, True),):
                    if not new:
                        gone.append((i, c, start + at, k))
                    elif hot[r]:
                        for j in range(at, at + k):
                            w = piece[j : j + LENGTH]
                            put(xxhash.xxh64_intdigest(w, SEED) - (1 << 63), w, (i, c, start + j, 1))
                    else:
                        put(key, piece[at : at + k + LENGTH - 1], (i, c, start + at, k))
        rows = [*best.values(), *gone]
        columns = [np.array([row[j] for row in rows], np.int64) for j in range(4)] if rows else [np.zeros(0, np.int64)] * 4
        spread = columns[0] * np.int64(31) + columns[2]
        keys = np.concatenate((np.array([k for k, _ in best], np.int64), spread[len(best) :]))
        texts = pa.array([t for _, t in best] + [None] * len(gone), pa.binary())
        arrays = [pa.array(keys), pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2].astype(np.int32)), pa.array(columns[3].astype(np.int32)), texts]
        yield pa.RecordBatch.from_arrays(arrays, ["key", "id", "c", "start", "n", "piece"])


def repeats_itself(text: bytes, n: int) -> bool:
    """Whether a run of n windows may have two equal ones: the bytes that all its windows share would come again."""
    return n > 1 and (n > LENGTH or text.find(text[n - 1 : LENGTH], n) >= 0)


def spans_of(rows: list[tuple[int, int, int, int, int, bytes | None]]) -> tuple[np.ndarray, ...]:
    """(id, c, s, e) to remove, from all rows (key, id, c, start, n, piece) of some keys, sorted by key."""
    out: list[tuple[int, int, int, int]] = []
    best: dict[tuple[int, bytes], tuple[int, int, int, int]] = {}
    for key, i, c, start, n, piece in rows:
        row = (i, c, start, n)
        if piece is not None:
            old = best.setdefault((key, piece), row)
            if old == row:
                continue
            if row < old:
                best[key, piece], row = row, old
        out.append((row[0], row[1], row[2], row[2] + row[3] + LENGTH - 1))
    keys = np.array([k for k, _ in best], np.int64)
    texts, kept = [t for _, t in best], list(best.values())
    if texts:
        alone = np.repeat(*(lambda size: (size == 1, size))(groups(keys)[1]))
        asked = [j for j in range(len(texts)) if not alone[j] or repeats_itself(texts[j], kept[j][3])]
        texts, kept = [texts[j] for j in asked], [kept[j] for j in asked]
    found = [np.array([x[j] for x in out], np.int64) for j in range(4)]
    if texts:
        ids, cs, start, n = (np.array([x[j] for x in kept], np.int64) for j in range(4))
        order = np.lexsort((cs, ids))
        new = np.ones(len(order), np.int64)
        new[1:] = (ids[order[1:]] != ids[order[:-1]]) | (cs[order[1:]] != cs[order[:-1]])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new)
        gone = repeated_windows(texts, n, (rank << 32) + start)
        edge = np.diff(np.concatenate(([0], gone.view(np.int8), [0])))
        a, z = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        begin = np.cumsum([0, *map(len, texts)])[:-1]
        of = np.searchsorted(begin, a, "right") - 1
        s = a - begin[of] + start[of]
        found = [np.concatenate(x) for x in zip(found, (ids[of], cs[of], s, s + (z - a) + LENGTH - 1), strict=True)]
    return tuple(found)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From pieces sorted by key, some whole keys of about BLOCK bytes at a time."""
    held: list[tuple] = []
    size, last = 0, None

    def found() -> pa.RecordBatch:
        i, c, s, e = spans_of(held)
        return pa.RecordBatch.from_arrays([pa.array(i), pa.array(c), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], ["id", "c", "s", "e"])

    for batch in batches:
        for row in zip(*(batch.column(x).to_pylist() for x in ("key", "id", "c", "start", "n", "piece")), strict=True):
            if size >= BLOCK and row[0] != last:
                yield found()
                held, size = [], 0
            held.append(row)
            last, size = row[0], size + 64 + len(row[5] or b"")
    if held:
        yield found()


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal stretches of bytes covered by ``spans``."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for s, e in spans:
        parts.append(text[at:s])
        at = e
    return b"".join([*parts, text[at:]])


def _cut(as_text: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the texts without their spans, or (as_text) those texts in place of the bytes."""
    for batch in batches:
        spans = [merged([(x["s"], x["e"]) for x in row.as_py() or ()]) for row in batch.column("spans")]
        texts = [t.as_py() for t in batch.column("text")]
        left = [without(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
        if as_text:
            # a character of which only a part stays goes as a whole
            out = [("left", pa.array([x.decode("utf-8", "ignore") for x in left], pa.string()))]
            rest = [c for c in batch.schema.names if c not in ("text", "spans")]
        else:
            out = [
                ("n_removed", pa.array([len(t) - len(x) for t, x in zip(texts, left, strict=True)], pa.int64())),
                ("n_spans", pa.array([len(s) for s in spans], pa.int64())),
                ("kept_sha256", pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string())),
            ]
            rest = ["id", "c"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *(x for _, x in out)], [*rest, *(name for name, _ in out)])


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    """(id, c, text as bytes) and ``more`` of every row; c, a hash of the text, tells texts with one doc_id apart."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    return docs.select(ids.alias("id"), F.xxhash64(text).alias("c"), text.alias("text"), *more)


def heads(docs: DataFrame) -> DataFrame:
    """(id, c, sha, n_bytes, rows, first) by doc_id and text, written: ``first`` says that no earlier document has this text."""
    each = _keyed(docs).select("id", "c", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes"))
    each = common.cut(each.groupBy("id", "c", "sha", "n_bytes").agg(F.count("*").alias("rows")), "suffix-heads")
    copied = each.groupBy("sha").agg(F.min("id").alias("least"), F.count("*").alias("n")).filter("n > 1")
    copied = common.cut(copied.select(F.col("sha").alias("of"), "least"), "suffix-copies")
    out = common.joined(each, copied, F.expr("sha = of"), "left", copied.count() * 112)
    return common.cut(out.select("id", "c", "sha", "n_bytes", "rows", F.coalesce(F.expr("id = least"), F.lit(True)).alias("first")), "suffix-firsts")


def spans(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """(id, c, spans) of the first documents that have something to remove."""
    runs = map_arrow(_keyed(docs), _runs, RUN)
    route = F.when(F.col("local") > 0, F.col("key")).otherwise(F.xxhash64("id", "start"))
    shared = map_arrow(runs.repartition(route).sortWithinPartitions("key"), _shared, SHARED)
    shared = common.cut(shared, "suffix-runs")
    hot = common.cut(shared.filter(F.col("total") > HOT).select("key").distinct().withColumn("many", F.lit(True)), "suffix-hot")
    spots = common.joined(shared, hot, ["key"], "left", hot.count() * 24)
    spot = F.struct("start", "n", "key", F.coalesce("many", F.lit(False)).alias("hot"))
    spots = spots.groupBy("id", "c").agg(F.collect_list(spot).alias("spots"))
    texts = _keyed(docs).join(firsts.select("id", "c"), ["id", "c"], "left_semi").join(spots, ["id", "c"])
    pieces = map_arrow(texts.select("id", "c", "text", "spots"), _pieces, PIECE)
    found = map_arrow(pieces.repartition("key").sortWithinPartitions("key"), _spans, SPAN)
    return found.groupBy("id", "c").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs``."""
    docs = docs.select("doc_id", "text")
    every = heads(docs)
    texts = _keyed(docs).join(spans(docs, every.filter(F.col("first") & (F.col("n_bytes") >= LENGTH))), ["id", "c"])
    # rows repeating doc_id and text give one row each here, all the same
    found = map_arrow(texts.select("id", "c", "text", "spans"), partial(_cut, False), "id long, c long, n_removed long, n_spans long, kept_sha256 string")
    found = found.dropDuplicates(["id", "c"])
    rows = every.join(found, ["id", "c"], "left").withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    copy = (~F.col("first") | (F.col("nth") > 1)) & (F.col("n_bytes") >= LENGTH)
    return rows.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated strings cut out of ``text``, and ``n_chars`` following; rows of which nothing is left go.

    A character that is cut in part goes as a whole. Rows without bytes stay.
    """
    every = heads(docs.select("doc_id", "text"))
    found = spans(docs.select("doc_id", "text"), every.filter(F.col("first") & (F.col("n_bytes") >= LENGTH)))
    rows = _keyed(docs.select("doc_id", "text", F.struct("*").alias("d")), "d")
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy("id", "c").orderBy("id")))
    rows = rows.join(every.select("id", "c", "first"), ["id", "c"]).filter((F.col("first") & (F.col("nth") == 1)) | (F.octet_length("text") < LENGTH))
    rows = rows.join(found, ["id", "c"], "left").select("d", "text", "spans")
    schema = T.StructType([rows.schema["d"], T.StructField("left", T.StringType())])
    rows = map_arrow(rows, partial(_cut, True), schema).filter((F.col("left") != "") | (F.coalesce("d.text", F.lit("")) == ""))
    new = {"text": F.when(F.col("d.text").isNotNull(), F.col("left")), "n_chars": F.length("left").cast("long")}
    return rows.select(*[(new[c] if c in new else F.col("d")[c]).alias(c) for c in docs.columns])


#: Windows are told apart by DuckDB's 64-bit hash.
SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, '')) AS n FROM documents),
p AS (SELECT doc_id, b, n, unnest(range(0, n)) AS i FROM d),
h AS (SELECT doc_id, i, hex(b[i + 1:i + 1]) AS byte, CASE WHEN i + 100 <= n THEN hash(b[i + 1:i + 100]) END AS h FROM p),
w AS (SELECT doc_id, i, byte, (h IS NOT NULL AND row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1)::INTEGER AS again FROM h),
g AS (SELECT doc_id, i, byte, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM w),
e AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 AS opens FROM g),
r AS (
  SELECT doc_id, sum(gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans, coalesce(string_agg(byte, '' ORDER BY i) FILTER (WHERE gone = 0), '') AS kept
  FROM e GROUP BY doc_id)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(r.n_removed, 0)::BIGINT AS n_removed, coalesce(r.n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(r.kept, ''))) AS kept_sha256
FROM d LEFT JOIN r ON d.doc_id = r.doc_id
"""
