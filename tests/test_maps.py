import json

import pytest

from millrace.operators import estate, retrieval
from millrace.sources import maps


def put(tmp_path, doc):
    p = tmp_path / "map.json"
    p.write_text(doc if isinstance(doc, str) else json.dumps(doc))
    return str(p)


def test_synonym_maps(spark, tmp_path):
    found = maps.read_synonyms(spark, put(tmp_path, {"syn": "base"})).collect()
    assert [tuple(r) for r in found] == [("SYN", "BASE")]
    for bad in ("[1]", "{", {"a": 1}):
        with pytest.raises(maps.MapError):
            maps.read_synonyms(spark, put(tmp_path, bad))


def test_dependents_maps(spark, tmp_path):
    path = put(tmp_path, {"a|PROGRAM": [{"name": "x", "kind": "JOB", "via": "EXEC"}], "b": []})
    coverage, edges = maps.read_dependents(spark, path)
    asks = spark.createDataFrame([(1, "A", "program"), (2, "B", "file"), (3, "C", None), (4, "A", None)], "seq long, name string, kind string")
    rows = {r["seq"]: (r["answer_status"], r["rows"] and [x["name"] for x in r["rows"]]) for r in estate.dependents(asks, coverage, edges).collect()}
    assert rows == {1: ("answered", ["X"]), 2: ("answered", []), 3: ("not-answered", None), 4: ("answered", ["X"])}
    for bad in ({"a": {}}, {"a": [{"kind": "JOB"}]}, {"a": [{"name": "x", "kind": "gadget"}]}):
        with pytest.raises(maps.MapError):
            maps.read_dependents(spark, put(tmp_path, bad))


def test_recorded_answers_round_trip(spark, tmp_path):
    asks = spark.createDataFrame([(1, "a", "proc"), (2, "b", None)], "seq long, name string, asked_type string")
    live = retrieval.ask_service(asks, lambda n, k: "T" if n == "a" else None)
    maps.write_answers(live, str(tmp_path / "answers"))
    back = estate.replayed(asks, maps.read_answers(spark, str(tmp_path / "answers")))
    assert sorted((r["seq"], r["outcome"]) for r in back.collect()) == [(1, "found"), (2, "not-found")]
