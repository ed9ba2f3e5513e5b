import random

import numpy as np
import pytest

from millrace.llm import hamming as hm


def brute(vectors, k):
    codes = {}
    for i, v in vectors:
        if i is not None and v is not None:
            codes.setdefault((i, sum(1 << j for j, x in enumerate(v) if x is not None and x > 0)), None)
    rows = list(codes)
    out = []
    for i, c in rows:
        if i % 100 == 0:
            near = sorted(((c ^ d).bit_count(), j) for j, d in rows if j != i)[:k]
            out += [(i, n + 1, j, d) for n, (d, j) in enumerate(near)]
    return sorted(out)


def found(spark, vectors, **more):
    df = spark.createDataFrame([(i, v, "extra") for i, v in vectors], "vec_id long, embedding array<float>, code string")
    return sorted(tuple(r) for r in hm.top_k(df, **more).collect())


def test_equals_brute_force_with_groups_of_equal_codes(spark):
    rng = np.random.default_rng(3)
    same = rng.normal(size=64).tolist()
    vectors = [(i, same if i % 3 == 0 else rng.normal(size=64).tolist()) for i in range(301)]
    vectors += [(7, vectors[7][1]), (None, same), (400, None), (500, [float("nan")] * 64), (501, [None] + [1.0] * 63)]
    assert found(spark, vectors) == brute(vectors, 10)


def test_small_parts_with_salts_and_prefixes(spark, monkeypatch):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    codes = [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(60)]
    vectors = [(i, [1.0 if c >> j & 1 else -1.0 for j in range(64)]) for i, c in enumerate(codes)]
    monkeypatch.setattr(hm, "VISITORS", 2)
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    coded = df.select("vec_id", hm.sign_code(df.embedding).alias("code"))
    rows = hm.search(coded, coded.filter("vec_id % 100 = 0"), k=5, part=16).collect()
    assert sorted(tuple(r) for r in rows) == brute(vectors, 5)


def test_fewer_than_k_and_empty(spark):
    vectors = [(0, [1.0, -1.0]), (1, [1.0, 1.0])]
    assert found(spark, vectors) == [(0, 1, 1, 1)]
    assert found(spark, []) == []


def test_segments_cover_all_bits():
    for n in (0, 1, 500, 50_000, 10**9, 10**12):
        layout = hm.segments(n)
        assert layout[0][0] == 0 and sum(w for _, w in layout) == 64


def test_too_wide_vectors_raise(spark):
    with pytest.raises(Exception, match="64 bits"):
        found(spark, [(0, [1.0] * 65)])
