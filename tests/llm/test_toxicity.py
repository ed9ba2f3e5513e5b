import random
import zlib

import numpy as np
import pytest

from millrace.llm import toxicity as tx

PLAIN = "the house of a river under green light while people walk along many quiet roads in early summer and talk about bread".split()
RUDE = ["blorkhead", "grumpfool", "snotwidget"]


def texts(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = rng.choices(PLAIN, k=rng.randint(5, 60))
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(RUDE))
        out.append((" ".join(words), int(toxic)))
    return out


@pytest.fixture(scope="module")
def model():
    known = texts(500, 1)
    return tx.train([t for t, _ in known], [y for _, y in known])


def test_held_out_accuracy(model):
    held = texts(300, 2)
    found = np.array([model.score(t) >= tx.THRESHOLD for t, _ in held])
    assert (found == np.array([y for _, y in held], bool)).mean() > 0.97


def test_unseen_misspellings_share_vectors(model):
    plain = " ".join(PLAIN)
    assert model.score(plain + " blorkheadz blorkheadd blorkheads") > model.score(plain + " quietly roadside summers") + 0.3


def test_training_is_repeatable(model):
    known = texts(500, 1)
    again = tx.train([t for t, _ in known], [y for _, y in known])
    assert again.score("a blorkhead walks") == model.score("a blorkhead walks")


def test_one_class_or_no_labels_score_zero():
    assert tx.train([], []).score("blorkhead") < 1e-9
    assert tx.train(["a", "b"], [0, 0]).score("a") < 1e-9


def test_query_over_tables(spark):
    known = texts(200, 3)
    docs = [(i, t, "en", None, len(t)) for i, (t, _) in enumerate(known)] + [(900, None, None, None, None), (901, "", "en", "s", 0), (None, "blorkhead", None, None, 1), (3, "repeated id", None, None, 1)]
    labels = [(i, 1, y) for i, (_, y) in enumerate(known)] + [(900, 1, None), (None, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    l = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = tx.scored(d, tx.fit(d, l)).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode() if r["doc_id"] is not None else b"") % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    assert tx.scored(d.limit(0), tx.Model()).collect() == []


def test_repeated_ids_leave_every_label_a_text_in_any_order(spark, monkeypatch):
    monkeypatch.setattr(tx, "MAX_LABELLED", 20)
    seen = []
    monkeypatch.setattr(tx, "train", lambda t, y: seen.append(list(zip(t, y, strict=True))))
    docs = [(i, f"text {k} of {i}") for i in range(60) for k in range(5)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    l = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    for rows in (d, d.repartition(3, "text"), d.orderBy("text")):
        tx.fit(rows, l)
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 40
    assert len({t.split()[-1] for t, _ in seen[0]}) == 20


def test_rows_speak_for_and_against():
    rng = random.Random(4)
    kind = ["gentleword", "kindlything"]
    known = [(t if y else t + " " + rng.choice(kind), y) for t, y in texts(400, 5)]
    model = tx.train([t for t, _ in known], [y for _, y in known])
    assert model.score("gentleword kindlything") < model.score("the house of a river") < model.score("blorkhead snotwidget")


def test_the_vocabulary_at_once_equals_word_by_word(model):
    long = " ".join(t for t, _ in texts(200, 6)) + " # ... " + "x" * 5000
    scorer = model.scorer()
    whole = scorer.scores([long, None, "", " \n", "...", long])
    weight = addend = 0.0
    for w in long.lower().split():
        row, _ = tx.gram_rows([w.strip(tx.EDGES)])
        trust = model.trust[row].mean()
        weight += trust
        addend += trust * (model.trust[row] * (model.vectors[row] @ model.w)).mean()
    assert abs(whole[0] - 1 / (1 + np.exp(-np.clip(addend / (1 + weight) + model.b, -30, 30)))) < 1e-4
    assert whole[0] == whole[5] and whole[1] == whole[2] == whole[3]


def test_extra_columns_with_clashing_names(spark):
    known = texts(100, 7)
    d = spark.createDataFrame([(i, t, 1, 2, 3) for i, (t, _) in enumerate(known)], "doc_id long, text string, held_out int, score int, predicted int")
    labels = spark.createDataFrame([(i, y, 5) for i, (_, y) in enumerate(known)], "doc_id long, toxic int, text int")
    found = tx.scored(d, tx.fit(d, labels))
    assert found.columns == ["doc_id", "held_out", "score", "predicted"] and found.count() == 100
