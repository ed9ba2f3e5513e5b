import json

from millrace import cli
from millrace.functions.timing import StageTimer
from millrace.operators import cobol
from millrace.streaming.members import stream_members

SOURCE = "       IDENTIFICATION DIVISION.\n       PROGRAM-ID. P.\n       DATA DIVISION.\n       COPY C.\n       PROCEDURE DIVISION.\n           GOBACK.\n"


def folder(tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "p.cbl").write_text(SOURCE)
    for d, name in (("one", "FIRST"), ("two", "SECOND")):
        (tmp_path / d).mkdir()
        (tmp_path / d / "c.cpy").write_text(f"       01 {name} PIC X.\n")
    return tmp_path


def test_bundles_from_the_command_line(spark, tmp_path):
    d = folder(tmp_path)
    assert cli.main([str(d / "src"), "-o", str(d / "out"), "-I", str(d / "one"), "-I", str(d / "two"), "--timing", "-q"]) == 0
    doc = json.loads(spark.read.parquet(str(d / "out")).first()["bundle"])
    assert doc["source"]["name"] == "p.cbl" and [x["name"] for x in doc["program"]["data_items"]] == ["FIRST"]
    assert cli.main([str(d / "src")]) == 2
    assert cli.main([str(d / "nowhere"), "-o", str(d / "out2"), "-q"]) == 1


def test_members_that_arrive(spark, tmp_path):
    d = folder(tmp_path)
    query = cobol.tokens(stream_members(spark, str(d / "src"))).writeStream.format("memory").queryName("arrived").outputMode("append").start()
    query.processAllAvailable()
    (d / "src" / "q.cbl").write_text(SOURCE.replace(" P.", " Q."))
    query.processAllAvailable()
    query.stop()
    rows = spark.sql("SELECT member, count(*) AS n FROM arrived GROUP BY member").collect()
    assert {r["member"]: r["n"] for r in rows} == {"P": 18, "Q": 18}


def test_a_failing_sink_is_no_failure():
    def sink(rows):
        raise RuntimeError

    timer = StageTimer(sink=sink)
    with timer.stage("x"):
        pass
    timer.report()
    assert timer.rows[0]["stage"] == "x"


def test_copybooks_from_a_service_and_from_its_record(spark, tmp_path, monkeypatch):
    d = folder(tmp_path)
    (d / "src" / "q.cbl").write_text(SOURCE.replace("COPY C.", "COPY DEEP.").replace("GOBACK", "EXEC SQL DELETE FROM SYN END-EXEC"))
    (d / "estate_for_tests.py").write_text("def fetch(name):\n    if name == 'C':\n        raise OSError('down')\n    return {'DEEP': '       COPY INNER.', 'INNER': '       01 GOT PIC X.'}.get(name)\n\ndef base(name):\n    return 'owner.real'\n")
    monkeypatch.syspath_prepend(str(d))
    spark.sparkContext.addPyFile(str(d / "estate_for_tests.py"))
    live = [str(d / "src"), "-o", str(d / "live"), "--fetcher", "estate_for_tests:fetch", "--jobs", "0", "-q"]
    assert cli.main([*live, "--gather-only", str(d / "answers")]) == 0 and not (d / "live").exists()
    assert cli.main([*live, "--synonym-resolver", "estate_for_tests:base"]) == 0
    assert cli.main([str(d / "src"), "-o", str(d / "back"), "--from-bundle", str(d / "answers"), "-q"]) == 0
    shown = {}
    for name in ("live", "back"):
        docs = [json.loads(r["bundle"]) for r in spark.read.parquet(str(d / name)).collect()]
        shown[name] = {x["source"]["name"]: ([i["name"] for i in x["program"]["data_items"]], [e[0] for e in x["copybookErrors"]]) for x in docs}
    assert shown["live"] == shown["back"] == {"p.cbl": ([], ["C"]), "q.cbl": (["GOT"], [])}
    assert [tuple(r) for r in spark.read.parquet(str(d / "live.tables")).select("member", "table", "base", "door").collect()] == [("Q", "SYN", "OWNER.REAL", "resolver")]
    assert cli.main([str(d / "src"), "-o", str(d / "no"), "--fetcher", "no.such:thing", "-q"]) == 2
