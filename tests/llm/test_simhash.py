import random
import re

import numpy as np
import xxhash

from millrace.llm import common
from millrace.llm import simhash as sh

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_fingerprint(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fps = [brute_fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted(((r[0], f"{fp:016x}", low.get(find(i))) for i, (r, fp) in enumerate(zip(rows, fps))), key=repr)


def corpus():
    rng = random.Random(8)
    words = "alpha beta Gamma delta é ÉA eta\x1ctheta iota KAPPA lam bda mu".split(" ")
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [prose(rng.randrange(1, 200)) for _ in range(60)]
    for _ in range(60):
        t = rng.choice(texts).split(" ")
        t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t))
    texts += [None, "", " \n", "one", "one two", "Two words\tand  more\n", texts[0]] + [texts[1]] * 20
    return [(i * 7 % 1009, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, texts[2], None, None, None)]


def test_equals_brute_force(spark):
    rows = corpus()
    found = sorted((tuple(r) for r in sh.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert found == brute(rows)


def test_dedup_keeps_one_row_of_each_component(spark):
    rows = corpus()
    want = {c for i, _, c in brute(rows) if i is not None}
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", fp long, rid long")
    kept = sh.dedup(df).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(want)
    assert sh.dedup(df.limit(0)).collect() == [] and sh.near_duplicates(df.limit(0)).collect() == []


def test_dedup_holds_when_the_splits_change_between_scans(spark, monkeypatch):
    rng = random.Random(5)
    prose = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(60))
    rows = [(i, prose(), "en", "s", 0) for i in range(400)]
    rows += [(1000 + i, rows[i][1], "en", "s", 0) for i in range(0, 400, 4)]
    rng.shuffle(rows)
    path = common.shared_path(spark, "test-splits")
    for at, n in enumerate((20, 90, 40, 70, 30, 60, 80, 50, 10, 25, 15, 10)):
        part, rows = rows[:n], rows[n:]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{path}/part={at}")
    docs = spark.read.parquet(path).drop("part")
    cut, parallelism = common.cut, "spark.sql.leafNodeDefaultParallelism"

    def cut_and_lose_an_executor(df, name):
        out = cut(df, name)
        if name == "simhash-rows":
            spark.conf.set(parallelism, "2")
        return out

    monkeypatch.setattr(common, "cut", cut_and_lose_an_executor)
    spark.conf.set(parallelism, "6")
    before = docs.rdd.getNumPartitions()
    try:
        kept = sh.dedup(docs).collect()
        assert spark.read.parquet(path).rdd.getNumPartitions() != before
    finally:
        spark.conf.unset(parallelism)
    assert sorted(r["doc_id"] for r in kept) == list(range(400))


def test_links_of_dense_cells_span_the_components(monkeypatch):
    monkeypatch.setattr(sh, "DENSE", 8)
    rng = np.random.default_rng(2)
    fp = np.unique(np.concatenate([np.uint64(0) ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)), rng.integers(0, 1 << 63, 50).astype(np.uint64)]))
    a, b = sh.links_within(fp)
    found = sh.forest(len(fp), a, b)
    x, y = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None]) <= 3)
    assert np.array_equal(found, sh.forest(len(fp), x, y))
    assert (np.bitwise_count(fp[a] ^ fp[b]) <= 3).all() or len(a) == 0


def test_hot_keys_are_looked_up_apart(spark, monkeypatch):
    rows = corpus()
    want = brute(rows)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((tuple(r) for r in sh.near_duplicates(df).collect()), key=repr) == want
    assert sorted(r["doc_id"] for r in sh.dedup(df).collect()) == sorted({c for i, _, c in want if i is not None})


def test_of_rows_that_share_id_and_text_one_stays(spark):
    rows = [(1, "one two three four", "b", "s", 0), (1, "one two three four", "a", "t", 0), (1, "another text of its own here", "c", "s", 0), (None, None, "n", None, None), (None, "", "m", None, None), (None, None, "n", None, None)]
    kept = sh.dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"] or 0, r["lang"]) for r in kept) == [(0, "n"), (1, "a"), (1, "c")]


def test_texts_of_more_words_than_a_slice():
    rng = random.Random(3)
    for n in (sh.SLICE - 1, sh.SLICE + 2, sh.SLICE + 3, 2 * sh.SLICE + 5):
        text = " ".join(rng.choice("abcdef") for _ in range(n))
        assert sh.fingerprint(text.encode()) == brute_fingerprint(text)
