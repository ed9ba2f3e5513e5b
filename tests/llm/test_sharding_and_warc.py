import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

from millrace.llm import common, sharding, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = random.Random(9)
    rows = [(i, " ".join("word%d" % rng.randrange(99) for _ in range(rng.randrange(40))), "en", "s", 0) for i in range(400)]
    return rows + [(500, None, None, None, None), (None, "é", None, None, None), (7, "other text", "en", "s", 0), rows[3], rows[3]]


def check_shards(rows, found):
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == want
    slots = defaultdict(list)
    shard = {}
    for r in found:
        slots[r["shard"]].append(r["slot"])
        assert shard.setdefault(r["doc_id"], (r["shard"], r["grown_shard"])) == (r["shard"], r["grown_shard"])
        assert r["law"] == "key" and 0 <= r["shard"] < 16 and r["grown_shard"] in (r["shard"], 16)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))


def test_shards(spark):
    rows = documents()
    df = spark.createDataFrame(rows, SCHEMA)
    found = sharding.sharded(df).collect()
    check_shards(rows, found)
    again = sharding.sharded(df.repartition(5)).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, found), key=repr)
    in_order = [r["doc_id"] for r in sorted(found, key=lambda r: (r["shard"], r["slot"])) if r["shard"] == 3]
    assert in_order != sorted(in_order, key=lambda x: (x is None, x))
    assert sharding.sharded(df.limit(0)).collect() == []


def brute_shard(key, shards):
    def draw(s):
        h = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), seed=42)
        for x in (s, sharding.SEED):
            h = xxhash.xxh64_intdigest(struct.pack("<i", x), seed=h)
        return h - (1 << 64) if h >> 63 else h, s

    return max(map(draw, range(shards)))[1]


def test_shards_and_slots_equal_brute_force(spark):
    rows = documents()
    groups = defaultdict(list)
    for r in rows:
        groups[brute_shard(r[0], 16)].append((r[0], zlib.crc32((r[1] or "").encode())))
    want = Counter()
    for shard, group in groups.items():
        group.sort(key=lambda x: (x[0] is not None, x))
        order = np.random.default_rng([sharding.SEED, shard, 0]).permutation(len(group))
        want.update((*group[i], shard, slot, brute_shard(group[i][0], 17)) for slot, i in enumerate(order.tolist()))
    found = sharding.sharded(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter((r["doc_id"], r["text_crc32"], r["shard"], r["slot"], r["grown_shard"]) for r in found) == want


def test_very_long_texts(spark):
    rows = [(1, "long é " * 2_000_000, "en", "s", 0), *documents()]
    check_shards(rows, sharding.sharded(spark.createDataFrame(rows, SCHEMA)).collect())


def test_small_buckets_and_a_heavy_id(spark):
    rows = documents() + [(1, "the same id " * 20, "en", "s", 0)] * 300
    df = spark.createDataFrame([(*r, 5, 6) for r in rows], SCHEMA + ", shard int, slot int")
    path = common.shared_path(spark, "test-shards")
    sharding.write_shards(df, path, bucket_bytes=512)
    back = spark.read.parquet(path)
    assert back.select("d.shard", "d.slot").distinct().collect() == [(5, 6)]
    assert Counter(r["doc_id"] for r in back.select("d.doc_id").collect()) == Counter(r[0] for r in rows)
    for group in _by_shard(back).values():
        assert sorted(group) == list(range(len(group)))


def test_slots_of_a_heavy_id_hold_when_the_splits_change_between_scans(spark, monkeypatch):
    path = common.shared_path(spark, "test-splits")
    for at, n in enumerate((20, 90, 40, 70, 30, 60, 80, 50, 10, 25, 15, 10)):
        rows = [(1, "the same id " * 20, "en", "s", 0)] * n
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/part={at}")
    docs = spark.read.parquet(path).drop("part")
    cut, parallelism = common.cut, "spark.sql.leafNodeDefaultParallelism"

    def cut_and_lose_an_executor(df, name):
        out = cut(df, name)
        if name == "granules":
            spark.conf.set(parallelism, "2" if spark.conf.get(parallelism) == "6" else "6")
        return out

    monkeypatch.setattr(common, "cut", cut_and_lose_an_executor)
    spark.conf.set(parallelism, "6")
    before = docs.rdd.getNumPartitions()
    try:
        out = common.shared_path(spark, "test-shards")
        # the first scatter counts at 6 and the second at 2; the rows are placed at 6 again
        sharding.write_shards(docs, out, bucket_bytes=512)
        spark.conf.set(parallelism, "2")
        assert spark.read.parquet(path).rdd.getNumPartitions() != before
    finally:
        spark.conf.unset(parallelism)
    groups = _by_shard(spark.read.parquet(out))
    assert sum(map(len, groups.values())) == 500
    for group in groups.values():
        assert sorted(group) == list(range(len(group)))


def _by_shard(back):
    out = defaultdict(list)
    for r in back.select("shard", "slot").collect():
        out[r["shard"]].append(r["slot"])
    return out


def pages():
    rng = random.Random(2)
    body = ["<p>%s</p>" % ("é%d " % k * rng.randrange(10, 900)) for k in range(12)]
    rows = [(i, f"http://h/{i}?q=é &\n", rng.choice(body)) for i in range(60)]
    return rows + [(70, None, None), (71, "", ""), (72, "u", "short"), (73, "u", "short"), (None, "n", body[0]), (None, "n", body[1] + "unique" * 300), rows[4]]


def test_archives_round_trip(spark):
    rows = pages()
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, size int")
    index = warc.write_archives(df, common.shared_path(spark, "test-warc"))
    keep = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000:
            keep[h] = max(keep.get(h, -1), -1 if i is None else i)
    records = warc.read_records(index).collect()
    assert len(records) == len(rows)
    assert Counter(r["url"] for r in records) == Counter(r[1] for r in rows)
    want = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        k = keep.get(h)
        revisit = k is not None and k != -1 and k != i
        want[(i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", k if revisit else None)] += 1
    assert Counter(map(tuple, warc.archived(df).collect())) == want
    payload = {r["page_id"]: bytes(r["payload"]) for r in records if r["record_type"] == "response" and r["page_id"] is not None}
    html = {r[0]: (r[2] or "").encode() for r in rows}
    assert all(html[i] == p for i, p in payload.items())
    some = warc.read_records(index.filter("page_id % 7 = 0"), with_payload=False)
    assert sorted({r["page_id"] for r in some.collect()}) == [i for i in range(0, 75, 7) if i in html]
    assert warc.archived(df.limit(0)).collect() == []


def test_neighbouring_records_share_a_read(monkeypatch):
    monkeypatch.setattr(warc, "GAP_BYTES", 10)
    monkeypatch.setattr(warc, "RANGE_BYTES", 100)
    rows = [("a", 0, 30), ("a", 35, 30), ("a", 90, 20), ("b", 0, 60), ("b", 60, 60)]
    assert list(warc.ranges(rows)) == [("a", 0, 65, [0, 1]), ("a", 90, 110, [2]), ("b", 0, 60, [3]), ("b", 60, 120, [4])]
