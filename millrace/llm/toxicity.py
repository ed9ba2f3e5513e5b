"""Toxicity scores from subword bags: averaged n-gram embeddings into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams (3 to 6
characters with word borders, and the whole word), so a misspelling shares most
of a known word's vectors. N-grams are hashed into ``BUCKETS`` rows. A text's
vector is the mean of its words' vectors, and a linear softmax over it gives the
score. All rows, the softmax and its bias are trained together, by full-batch
Adam with decay, for and against toxicity; rows that no training text has stay
zero.

A few words make a long text toxic, and a plain mean would drown them. So a row
has a trust between 0 and 1 that shrinks its vector: how far the texts that have
it, by their number, stray from the base rate, to either side. A word weighs as
much as its rows are trusted on average, and the mean has one more part, of
weight one, for nothing at all. At the end the bias is moved so that the score
at which training rows part best (by F1) is ``THRESHOLD``.

Labels are learnt only from rows with crc32(doc_id as text) mod 3 other than 1,
at most ``MAX_LABELLED`` of them (the smallest by a seeded hash of doc_id). Where
documents repeat a doc_id, all their texts are learnt from up to twice as many
rows: one text of every label, by text hash, before a second one of any. What
scoring needs of the model, one number a row, travels with its function.

Cases with a defined result: null and empty texts score as the bias alone;
texts are scored whole; null doc_ids are scored and held out only if the crc32
of the empty string says so; null labels are not learnt from; without both
classes among the labels every score is 0; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from millrace.functions.shipping import map_arrow

MAX_LABELLED = 8000
BUCKETS = 1 << 17
DIM = 4
STEPS = 40
RATE = 0.3
#: A row at this many deviations from chance is half trusted, by this power.
EVIDENCE = 3.0
POWER = 8.0
DECAY = 1e-5
SEED = 11
THRESHOLD = 0.7
MEMO = 300_000
#: Words hashed together, texts scored together.
WORDS_AT_ONCE = 20_000
TEXTS_AT_ONCE = 500
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
EDGES = ".,;:!?\"'()[]{}…#%&|<>-"


def fold(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 3; 1 is held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3))


def gram_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, word) of every n-gram of the words, word by word: a polynomial hash of its code points."""
    shown = [f"<{w}>" for w in words]
    size = np.fromiter(map(len, shown), np.int64, len(shown))
    code = np.frombuffer("".join(shown).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), size)
    end = np.cumsum(size)
    left = end[word] - np.arange(len(code))  # characters of the word from each on
    hashed, n = code.copy(), 1
    keys, owners = [], []
    while n < 6:
        n += 1
        hashed = hashed[:-1] * MULTIPLIER + code[n - 1 :]
        if n >= 3:
            at = np.flatnonzero(left[: len(hashed)] >= n)
            keys.append(hashed[at] + np.uint64(n))
            owners.append(word[at])
    power = np.multiply.accumulate(np.full(int(size.max(initial=1)), MULTIPLIER))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(code * power[size[word] - left])))
    keys.append(sums[end] - sums[end - size])
    owners.append(np.arange(len(words)))
    key, owner = np.concatenate(keys), np.concatenate(owners)
    key = (key ^ (key >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    order = np.argsort(owner, kind="stable")
    return ((key >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int32)[order], owner[order]


def words_of(text: str | None) -> list[str]:
    """The words of a text without signs at their edges; one of signs only is the empty word."""
    return [x.strip(EDGES) for x in (text or "").lower().split()]


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for size[0] places, then the same of the next."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def group_sums(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The sums of the groups of ``size`` values that begin at ``begin``, zero for empty ones."""
    out = np.zeros(len(size), values.dtype)
    full = size > 0
    if full.any():
        out[full] = np.add.reduceat(values, begin[full])
    return out


@dataclass
class Model:
    """A vector and a trust between 0 and 1 a row, and the softmax: its two classes differ by ``w`` and ``b``."""

    vectors: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, DIM), np.float32))
    trust: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, np.float32))
    w: np.ndarray = field(default_factory=lambda: np.zeros(DIM, np.float32))
    b: float = -30.0

    def scorer(self) -> Scorer:
        return Scorer((self.vectors @ self.w).astype(np.float32), self.trust, self.b)

    def score(self, text: str | None) -> float:
        return float(self.scorer().scores([text])[0])


class Scorer:
    """Scores texts. The softmax is linear, so a row is one number, a word the mean of its rows' and a text that of its words'."""

    def __init__(self, rows: np.ndarray, trust: np.ndarray, b: float) -> None:
        self.rows, self.trust, self.b = rows * trust, trust, b
        #: by word: its weight in a text's mean, and that times its number
        self.weight: dict[str, float] = {}
        self.addend: dict[str, float] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.weight) + len(words) > MEMO:
            kept = words & self.weight.keys()
            self.weight, self.addend = {w: self.weight[w] for w in kept}, {w: self.addend[w] for w in kept}
        new = list(words - self.weight.keys())
        for at in range(0, len(new), WORDS_AT_ONCE):
            part = new[at : at + WORDS_AT_ONCE]
            row, word = gram_rows([w.strip(EDGES) for w in part])
            size = np.bincount(word, minlength=len(part))
            weight = np.bincount(word, self.trust[row], len(part)) / size
            self.weight.update(zip(part, weight.tolist(), strict=True))
            self.addend.update(zip(part, (weight * np.bincount(word, self.rows[row], len(part)) / size).tolist(), strict=True))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Class 1's share for each text."""
        split = [(t or "").lower().split() for t in texts]
        self.learn(set().union(*split))
        weight, addend = self.weight.__getitem__, self.addend.__getitem__
        mean = np.array([sum(map(addend, words)) / (1 + sum(map(weight, words))) for words in split])
        return 1 / (1 + np.exp(-np.clip(mean + self.b, -30, 30)))


def by_column(column: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, begin, size): the entries sorted by column, where each of n columns begins and how many it has."""
    size = np.bincount(column, minlength=n)
    return np.argsort(column, kind="stable").astype(np.int32), np.cumsum(size) - size, size


def train(texts: list[str | None], labels: list[int]) -> Model:
    """The model of labelled texts; full-batch Adam with a fixed seed and number of steps.

    The softmax is linear, so a step needs no vector of any text: a row's share
    in a logit goes forth, and what the logits lack comes back, as one number.
    """
    y = np.array(labels, np.float32)
    if not 0 < y.sum() < len(y):
        return Model()
    # words as numbers; of each text its different words and their times, of each word its rows
    number: dict[str, int] = {}
    counted = [np.unique(np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int32), return_counts=True) for t in texts]
    word = np.concatenate([x for x, _ in counted])
    times = np.concatenate([c for _, c in counted]).astype(np.float32)
    n_words = np.array([len(x) for x, _ in counted])
    vocabulary = list(number)
    del number, counted
    rows, sizes = [], []
    for at in range(0, len(vocabulary), WORDS_AT_ONCE):
        row, owner = gram_rows(vocabulary[at : at + WORDS_AT_ONCE])
        rows.append(row)
        sizes.append(np.bincount(owner))
    gram, n_grams, n_vocabulary = np.concatenate(rows), np.concatenate(sizes), len(vocabulary)
    del vocabulary, rows, sizes
    used = np.flatnonzero(np.bincount(gram, minlength=BUCKETS))  # the rows that occur, numbered anew
    place = np.zeros(BUCKETS, np.int32)
    place[used] = np.arange(len(used))
    gram = place[gram]
    first_gram, first_word = np.cumsum(n_grams) - n_grams, np.cumsum(n_words) - n_words
    # in how many texts, and toxic texts, a row is: the further from chance, the more it is trusted
    rate, seen = y.mean(), np.zeros((2, len(used)))
    for i, (at, n) in enumerate(zip(first_word, n_words, strict=True)):
        of = word[at : at + n]
        seen[int(y[i]), np.unique(gram[spread(first_gram[of], n_grams[of])])] += 1
    z = np.abs(seen[1] - seen.sum(0) * rate) / np.sqrt(seen.sum(0) * rate * (1 - rate) + 1)
    trust = (z**POWER / (z**POWER + EVIDENCE**POWER)).astype(np.float32)
    weight = (group_sums(trust[gram], first_gram, n_grams) / n_grams).astype(np.float32)
    share = weight[word] * times
    share /= np.repeat(1 + group_sums(share, first_word, n_words), n_words)
    # the same entries by word and by row, for the way back
    order, doc_begin, doc_size = by_column(word, n_vocabulary)
    doc, share_back = np.repeat(np.arange(len(y), dtype=np.int32), n_words)[order], share[order]
    order, word_begin, word_size = by_column(gram, len(used))
    word_back = np.repeat(np.arange(n_vocabulary, dtype=np.int32), n_grams)[order]
    del order, times
    rng = np.random.default_rng(SEED)
    params = [np.zeros((len(used), DIM), np.float32), rng.normal(0, 1, DIM).astype(np.float32), np.zeros(1, np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def logits(vectors: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
        of_word = group_sums((trust * (vectors @ w))[gram], first_gram, n_grams) / n_grams
        return group_sums((of_word[word] * share).astype(np.float32), first_word, n_words) + b

    for step in range(1, STEPS + 1):
        vectors, w, b = params
        error = ((1 / (1 + np.exp(-np.clip(logits(*params), -30, 30))) - y) / len(y)).astype(np.float32)
        lacks = (group_sums(error[doc] * share_back, doc_begin, doc_size) / n_grams).astype(np.float32)
        lacks = trust * group_sums(lacks[word_back], word_begin, word_size)
        grads = [lacks[:, None] * w + DECAY * vectors, vectors.T @ lacks + DECAY * w, np.array([error.sum()])]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            move = (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
            params[i] = (params[i] - RATE * (1 - step / (STEPS + 1)) * move).astype(np.float32)
    vectors, w, b = params
    out = Model(w=w, b=float(b[0]) + shift(logits(*params), y))
    out.vectors[used], out.trust[used] = vectors, trust
    return out


def shift(logits: np.ndarray, y: np.ndarray) -> float:
    """What to add to the logits so that the threshold falls in the middle of the gap that parts the classes with the best F1."""
    order = np.argsort(-logits, kind="stable")
    z, hits = logits[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][z[:-1] == z[1:]] = 0
    best = int(f1.argmax())
    below = z[best + 1] if best + 1 < len(z) else z[best] - 2
    return float(np.log(THRESHOLD / (1 - THRESHOLD)) - (z[best] + below) / 2)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Trains on the labelled rows outside the held-out fold: ``MAX_LABELLED`` labels at most, and twice as many rows of them."""
    known = labels.filter(F.col("toxic").isNotNull()).select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter(fold(F.col("id")) != 1).distinct()
    known = known.orderBy(F.xxhash64("id"), "id", "toxic").limit(MAX_LABELLED)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("id")).select("id", "text", "toxic")
    nth = F.row_number().over(W.partitionBy("id", "toxic").orderBy(F.xxhash64("text"), "text"))
    rows = rows.withColumn("nth", nth).orderBy("nth", F.xxhash64("id"), "id", "toxic", F.xxhash64("text"), "text").limit(2 * MAX_LABELLED)
    found = sorted(rows.select("id", "text", "toxic").toArrow().to_pylist(), key=lambda r: (r["id"], r["toxic"], r["text"] or ""))
    return train([r["text"] for r in found], [r["toxic"] for r in found])


def _scored(scorer: Scorer, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        parts = [scorer.scores(texts[at : at + TEXTS_AT_ONCE]) for at in range(0, len(texts), TEXTS_AT_ONCE)]
        scores = np.concatenate([np.zeros(0), *parts])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    rows = docs.select("doc_id", "text", (fold(F.col("doc_id")) == 1).alias("held_out"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = map_arrow(rows, partial(_scored, model.scorer()), f"doc_id {kind}, held_out boolean, score double")
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
