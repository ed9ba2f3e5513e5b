"""The pipeline's stages against what brute force says of each stage's own input."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from millrace.llm import bpe, queries
from tests.llm import test_quality_and_mixing as quality
from tests.llm import test_simhash as near
from tests.llm import test_suffix_dedup as exact

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rng = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = prose(60)
    texts = [prose(rng.randrange(25, 120)) for _ in range(120)]
    texts += [prose(30) + " " + passage + " " + prose(40) for _ in range(6)]
    texts += [rng.choice(texts) for _ in range(10)]
    texts += [rng.choice(texts) + " end" for _ in range(5)]
    texts += ["short one", None, "", "again and again and again " * 40]
    return [(i, t, "en", rng.choice(["a", "b", "c", None]), len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    out = [spark.read.parquet(f"{d}/documents.parquet")]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], str(d)).write.parquet(f"{d}/{i}")
        out.append(spark.read.parquet(f"{d}/{i}"))
    return str(d), [[tuple(r) for r in x.collect()] for x in out], [x.columns for x in out]


def test_columns_of_documents_up_to_the_last_stage(stages):
    assert all(c == COLUMNS for c in stages[2][:5])


def test_quality_keeps_just_the_good_documents(stages):
    before, after = stages[1][0], stages[1][1]
    good = [r[0] for r in before if (c := quality.counts(r[1]))[0] >= 20 and 100 * c[4] <= 30 * c[0]]
    assert sorted(r[0] for r in after) == sorted(good)


def test_one_document_of_each_near_group_stays(stages):
    before, after = stages[1][1], stages[1][2]
    assert {r[0] for r in after} == {c for _, _, c in near.brute(before)}
    assert len(after) == len({r[0] for r in after}) < len(before)


def test_repeats_are_cut(stages):
    before, after = stages[1][2], {r[0]: r for r in stages[1][3]}
    for doc_id, n, removed, _, _ in exact.brute(before):
        assert (doc_id in after) == (removed < n)
        if doc_id in after:
            assert len(after[doc_id][1].encode()) == n - removed and after[doc_id][4] == len(after[doc_id][1])
    assert any(removed for _, _, removed, _, _ in exact.brute(before))


def test_the_mix_reaches_its_targets(stages):
    before, after = stages[1][3], stages[1][4]
    size = {r[0]: len(quality.WORD.findall(r[1] or "")) for r in before}
    total = Counter()
    for r in before:
        total[r[3]] += size[r[0]]
    want, taken = quality.targets(total), Counter()
    for r in after:
        taken[r[3]] += size[r[0]]
    assert max(Counter(r[0] for r in after).values()) <= 2
    for s in total:
        assert abs(taken[s] - want[s]) <= max(size[r[0]] for r in before if r[3] == s)


def test_ids_decode(stages):
    coder = bpe.Bpe(queries.vocabulary_path())
    rows = [dict(zip(stages[2][5], r, strict=True)) for r in stages[1][5]]
    text = {r[0]: r[1] for r in stages[1][4]}
    assert len(rows) == len(stages[1][4])
    for r in rows[:50]:
        assert list(r["ids"]) == coder.encode(text[r["doc_id"]]) and len(r["ids"]) == r["n_tokens"]


def test_run_is_the_stages_in_a_row(spark, stages):
    found = corpus_pipeline.run(spark, stages[0]).collect()
    assert Counter((r["doc_id"], r["ids_sha256"]) for r in found) == Counter((r[stages[2][5].index("doc_id")], r[stages[2][5].index("ids_sha256")]) for r in stages[1][5])
