import hashlib
import os
import random
import subprocess
import sys

import pytest

from millrace.llm import bpe, queries

pytest.importorskip("tokenizers")
PATH = queries.vocabulary_path()
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="needs the vocabulary file")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def texts():
    rng = random.Random(6)
    fixed = ["", " ", "Hello, World! it's 1234 o'clock", "ÀÉÎ straße ﬁ ＡＢＣ", "日本語 テキスト 🙂🙂 👩‍👩‍👧", "a\x1cb\x1dc d　e​f", "é café İstanbul ǅ", "<|startoftext|>x<|endoftext|><|endoftext|>", "<|EndOfText|>", "x" * 3000, "####%%%%&&&&", "a\x00b\x7f", "don't we'll I'VE", "Ωμέγα Привет שלום"]
    alphabet = "abcdefghij klmno pqrst uvwxyz ABC éüß 0123 '.,;!-_ \n\té日🙂́"
    return fixed + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 120))) for _ in range(300)]


def test_ids_and_decoding_equal_the_library(library):
    own = bpe.Bpe(PATH)
    for t in texts():
        want = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == want, t
        assert own.decode(want) == library.decode(want, skip_special_tokens=False), t


def test_query_over_a_table(spark, library):
    rows = [(i, t, "n") for i, t in enumerate(texts())] + [(None, None, None), (3, texts()[3], "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        shown = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()))
    assert sorted(map(tuple, bpe.digests(df, PATH).collect()), key=repr) == sorted(want, key=repr)
    coded = bpe.encode(df.select("doc_id", "text"), PATH)
    back = bpe.decode(coded.select("doc_id", "ids"), PATH)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {r[0]: library.decode(library.encode(r[1] or "", add_special_tokens=False).ids, skip_special_tokens=False) for r in rows}
    assert bpe.digests(df.limit(0), PATH).collect() == []


def test_many_words_at_once_equal_one_by_one():
    own, rng = bpe.Bpe(PATH), random.Random(7)
    words = sorted({"".join(rng.choice("aeinrst hé日") for _ in range(rng.randrange(1, 40))).replace(" ", "") or "x" for _ in range(500)})
    ids, counts = own.all_word_ids([w.encode() for w in words])
    parts, at = [], 0
    for n in counts.tolist():
        parts.append(ids[at : at + n].tolist())
        at += n
    assert parts == [own.word_ids(w.encode()) for w in words]


def test_the_automaton_holds_every_part_once():
    rng = random.Random(8)
    sequences = [list(x) for x in {tuple(rng.randrange(3) for _ in range(rng.randrange(1, 7))) for _ in range(40)}]
    made = bpe.SuffixAutomaton(sequences)
    parts = {tuple(x[a:b]) for x in sequences for a in range(len(x)) for b in range(a + 1, len(x) + 1)}
    walked, todo = set(), [((), 0)]
    while todo:
        path, state = todo.pop()
        for key, to in made.step.items():
            if key >> 9 == state:
                walked.add((*path, key & 511))
                todo.append(((*path, key & 511), to))
    assert walked == parts
    assert all(made.longest[state] == len(x) for state, x in zip(made.final, sequences, strict=True))


def test_very_long_texts_go_in_parts(library, monkeypatch):
    own = bpe.Bpe(PATH)
    monkeypatch.setattr(bpe, "GROUP", 50)
    long = " ".join(texts()[20:60]) + " <|endoftext|>" + "y" * 400 + " 日本 x"
    assert own.encode(long) == library.encode(long, add_special_tokens=False).ids
    (ids, shown), empty = own.coded([long, None])
    assert shown == library.decode([int(x) for x in ids.split()], skip_special_tokens=False)
    assert empty == ("", "")


def test_a_loaded_vocabulary_holds_its_tables_only():
    """What building the tables took is given back: two workers share an executor's memory with its JVM."""
    code = f"""
import re
from millrace.llm import bpe
def held():
    return int(re.search(r"Anonymous:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024
before = held()
bpe.loaded({PATH!r})
print(held() - before)
"""
    found = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__))))
    assert float(found.stdout.split()[-1]) < 50
