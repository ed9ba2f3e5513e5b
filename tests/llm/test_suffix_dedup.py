import hashlib
import random

import numpy as np
import pytest

from millrace.llm import suffix_dedup as sd

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows):
    """(doc_id, n_bytes, n_removed, n_spans, sha) by a dictionary of all windows."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    seen, out = set(), []
    for i in order:
        t = (rows[i][1] or "").encode()
        gone = bytearray(len(t))
        new = []
        for p in range(len(t) - sd.LENGTH + 1):
            w = t[p : p + sd.LENGTH]
            if w in seen:
                gone[p : p + sd.LENGTH] = b"\1" * sd.LENGTH
            else:
                seen.add(w)
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for p in range(len(t)) if gone[p] and not (p and gone[p - 1]))
        out.append((rows[i][0], len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
        del new
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    words = ["ab", "cde", "é", "ghij", "klm", "no", "p", "日本", "aa"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))
    passages = [prose(40) for _ in range(4)]
    texts = [prose(rng.randrange(1, 80)) + rng.choice(passages) + prose(rng.randrange(60)) for _ in range(60)]
    texts += [rng.choice(texts) for _ in range(15)]  # whole copies
    for _ in range(15):  # near copies
        t = rng.choice(texts)
        k = rng.randrange(len(t))
        texts.append(t[:k] + "XY" + t[k + 1 :])
    texts += ["a" * 400, "ab" * 150, "abc" * 99 + "x", None, "", "short", "z" * 99, "z" * 100, "z" * 101, "q" * 3000 + passages[0]]
    texts += [("0123456789" * 9 + "!" + passages[1]) * 3, "line one of the text\n" * 30]
    rng.shuffle(texts)
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


def result(spark, rows):
    return sorted((tuple(r) for r in sd.repeats(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    assert result(spark, rows) == brute(rows)


def test_hot_keys_go_window_by_window(spark, monkeypatch):
    monkeypatch.setattr(sd, "HOT", 3)
    rows = corpus(3)
    assert result(spark, rows) == brute(rows)


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(5)
    for k in (2, 3, 256):
        t = rng.integers(0, k, 700).astype(np.uint8)
        t = np.concatenate((t, t[100:400], np.full(50, 1, np.uint8)))
        raw = t.tobytes()
        found = sd.suffix_array(t, depth=len(t))
        assert found.tolist() == sorted(range(len(t)), key=lambda i: raw[i:])


def test_small_segments_and_blocks_change_nothing():
    texts = [(t or "").encode() for _, t, *_ in corpus(4)]
    texts = [t for t in texts if len(t) >= sd.LENGTH]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    key, place, n, _ = sd.runs_of(data, ends - [len(t) for t in texts], ends)
    assert n.sum() == sum(len(t) - sd.LENGTH + 1 for t in texts)
    old, sd.SEGMENT = sd.SEGMENT, 256
    sd._tables.cache_clear()
    try:
        key2, place2, n2, _ = sd.runs_of(data, ends - [len(t) for t in texts], ends)
    finally:
        sd.SEGMENT = old
        sd._tables.cache_clear()
    assert np.array_equal(np.repeat(key, n), np.repeat(key2, n2))


def test_nulls_ties_repeated_rows_and_empty_tables(spark):
    a, b = "x1 " * 50, "some text that is long enough to be looked at, " * 4
    rows = [(None, a, None, None, None), (None, a, None, None, None), (7, a, None, None, None), (7, b, None, None, None), (7, b, None, None, None), (8, None, None, None, None)]
    found = result(spark, rows)
    assert len(found) == 6
    whole = [r for r in found if r[2] == r[1] and r[1]]
    assert [r[0] for r in whole] == [7, 7, None]
    assert result(spark, []) == []


def test_dedup_cuts_texts_and_keeps_other_columns(spark):
    passage = "a passage of the same words that many of the documents share, é and so on, to be longer than one hundred bytes. "
    rows = [(1, "first " + passage + "tail", "en", "s", 1), (2, "other " + passage + "end", "fr", "t", 2), (3, passage, None, None, 3), (4, None, None, None, None), (5, "", None, None, 0)]
    df = spark.createDataFrame([(*r, i, f"e{i}") for i, r in enumerate(rows)], SCHEMA + ", id long, `a.b` string")
    found = {r["doc_id"]: r for r in sd.dedup(df).collect()}
    assert sorted(found) == [1, 2, 4, 5]
    assert found[1]["text"] == rows[0][1]
    assert found[2]["text"] == "otherend" and found[2]["n_chars"] == 8 and found[2]["id"] == 1 and found[2]["a.b"] == "e1"
    assert found[4]["text"] is None
