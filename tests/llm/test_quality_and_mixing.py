import math
import random
import re
from collections import Counter, defaultdict

from millrace.llm import common, mixing, quality_rules as qr

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rng = random.Random(4)
    words = "ab cd# ef$ gh Ij* kl mn é日".split()
    texts = []
    for _ in range(80):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 30))) for _ in range(rng.randrange(1, 6))]
        if rng.random() < 0.75:
            lines.insert(0, "Shared  HEADER line " + str(rng.randrange(99)))
        if rng.random() < 0.2:
            lines.append(lines[0])
        texts.append("\n".join(lines))
    texts += [None, "", "\n\n", "x " * 500, " ".join(map(str, range(900))), texts[3], texts[3], texts[4], "a\x0bb\x1cc d"]
    rows = [(i, t, "en", rng.choice(["a", "b", "é", None]), 0) for i, t in enumerate(texts)]
    return rows + [rows[5], (None, "null id " * 30, None, "b", None)]


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {p for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def normal(line):
    line = re.sub(r"[\x20\x09-\x0D]", " ", line).lower()
    return re.sub(" {2,}", " ", re.sub("[0-9]+", "0", line)).strip(" ")


def frequent(rows):
    hosts = defaultdict(set)
    for _, t, _, s, _ in rows:
        hosts[s].add(t or "")
    hot = {}
    for s, texts in hosts.items():
        n = Counter(x for t in texts for x in {normal(y) for y in t.split("\n") if WORD.search(y)})
        hot[s] = {x for x, k in n.items() if k > qr.MIN_LINE_DOCS and k > min(len(texts) * qr.HOST_SHARE, qr.MAX_LINE_DOCS)}
    return hot


def test_quality_report_equals_brute_force(spark):
    rows = corpus()
    hot = frequent(rows)
    assert any(hot.values())
    want = []
    for i, t, _, s, _ in rows:
        n, chars, symbols, dup, rep = counts(t)
        bad = n < 20 or 100 * rep > 30 * n
        left = sum(len(WORD.findall(x)) for x in (t or "").split("\n") if not (WORD.search(x) and normal(x) in hot[s]))
        want.append((i, n, chars, symbols, dup, rep, bad, not bad and 100 * left >= 30 * n))
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", d string")
    assert sorted(map(tuple, qr.quality_report(df).collect()), key=repr) == sorted(want, key=repr)
    kept = qr.keep_good(df).collect()
    assert Counter(r["doc_id"] for r in kept) == Counter(w[0] for w in want if w[-1])
    for r in kept:
        assert not any(WORD.search(x) and normal(x) in hot[r["source"]] for x in r["text"].split("\n"))
        assert r["n_chars"] == len(r["text"]) and r["d"] == "x"
    assert qr.quality_report(df.limit(0)).collect() == []


def test_boilerplate_of_a_large_host_goes_and_clean_documents_stay(spark, monkeypatch):
    monkeypatch.setattr(qr, "MAX_LINE_DOCS", 30)
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choices("aeiourst", k=5)) for _ in range(n))
    notice = ["All rights are reserved by the makers of this very page and its friends, see page 7.", "You have to be signed in, in order to read the rest of what stands here today."]
    clean = [(i, prose(40) + "\n" + prose(20), "en", "big", 0) for i in range(2000)]
    framed = [(3000 + i, f"{notice[0]}\n{prose(60)}", "en", "big", 0) for i in range(20)]
    bare = [(4000 + i, "\n".join([*notice, *notice]) + f"\nnr {prose(2)}", "en", "big", 0) for i in range(40)]
    rows = clean + framed + bare
    kept = {r["doc_id"]: r["text"] for r in qr.keep_good(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(kept) == {r[0] for r in clean + framed}
    assert all(kept[r[0]] == r[1] for r in clean) and all(kept[r[0]] == r[1].split("\n")[1] for r in framed)


def test_hot_lines_are_looked_up_apart(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(tuple, qr.quality_report(df).collect()), key=repr)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    assert sorted(map(tuple, qr.quality_report(df).collect()), key=repr) == want


def test_very_long_texts_and_clashing_columns(spark):
    long = "\n".join(" ".join(f"v{i}x{j}" for j in range(9)) for i in range(20_000))
    rows = [(1, long, "en", "s", 0), (2, None, None, None, None), (3, "x y " * 100_000, "en", "s", 0)]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6) for r in rows], SCHEMA + ", size long, key long, rid long, copies long, lost long, host long")
    found = {r["doc_id"]: r for r in qr.quality_report(df).collect()}
    assert (found[1]["n_words"], found[1]["kept"]) == (180_000, True) and (found[3]["n_repeat_words"], found[3]["kept"]) == (200_000, False)
    assert [(r["doc_id"], r["text"], r["lost"]) for r in qr.keep_good(df).collect()] == [(1, long, 5)]
    mix = {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.mix_plan(df).collect()}
    assert mix[1][0] == 180_000 and mix[2] == (0, 0) and mix[3][0] == 200_000
    assert {(r["size"], r["key"], r["rid"], r["copies"]) for r in mixing.mixed(df).collect()} == {(1, 2, 3, 4)}


def targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        w = sum(weight[s] for s in order if s not in full)
        out = {s: 2.0 * sizes[s] if s in full else rest * weight[s] / w for s in order}
        more = {s for s in order if s not in full and out[s] > 2 * sizes[s]}
        if not more:
            return out
        full |= more


def test_mix_follows_the_contract(spark):
    rows = corpus()
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = targets(sizes)
    df = spark.createDataFrame(rows, SCHEMA)
    found = mixing.mix_plan(df).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in rows)
    assert sorted(map(tuple, mixing.mix_plan(df.repartition(3)).collect()), key=repr) == sorted(map(tuple, found), key=repr)
    source = {r[0]: r[3] for r in rows}
    taken = Counter()
    for r in found:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and math.isclose(r["target"], want[s])
        assert r["taken"] in {0, r["size"], 2 * r["size"]}
        taken[s] += r["taken"]
    for s in sizes:
        most = max((len(WORD.findall(t or "")) for _, t, _, x, _ in rows if x == s), default=0)
        assert abs(taken[s] - want[s]) <= most
    copies = Counter(r["doc_id"] for r in mixing.mixed(df).collect())
    for r in found:
        if r["size"] and r["doc_id"] != 5:
            assert copies[r["doc_id"]] == r["taken"] // r["size"]
    assert mixing.mix_plan(df.limit(0)).collect() == [] and mixing.mixed(df.limit(0)).collect() == []
