from pyspark.sql import functions as F

from millrace.operators import cobol, estate, retrieval
from millrace.operators.closure import reachable
from millrace.sources.members import read_members


def test_service_answers_and_failures_stay_apart(spark):
    def service(name, kind):
        if name == "BOOM":
            raise RuntimeError("down")
        return {"A": "text", "B": None, "C": ("t", "lib(C)"), "D": {"found": True, "text": b"\xe9", "detected_type": "asm"}, "E": {"found": False}, "F": 7, "G": "  "}[name]

    asks = spark.createDataFrame([(i, n, None) for i, n in enumerate(["A", "B", "C", "D", "E", "F", "G", "BOOM"])], "seq long, name string, asked_type string")
    rows = {r["name"]: r for r in retrieval.ask_service(asks, service, jobs=2).collect()}
    assert {n: r["outcome"] for n, r in rows.items()} == {"A": "found", "B": "not-found", "C": "found", "D": "found", "E": "not-found", "F": "error", "G": "not-found", "BOOM": "error"}
    assert rows["C"]["source"] == "lib(C)" and rows["D"]["text"] == "é" and rows["D"]["detected_type"] == "asm"
    assert rows["BOOM"]["error"] == "RuntimeError: down"


def test_live_and_replayed_answers_agree(spark):
    asks = spark.createDataFrame([(1, "a", None), (2, "b", "cobol"), (3, "a", None)], "seq long, name string, asked_type string")
    live = retrieval.ask_service(asks, lambda n, k: "T" if n == "a" else None)
    back = estate.replayed(asks, live)
    want = sorted((r["seq"], r["outcome"], r["text"]) for r in live.collect())
    assert sorted((r["seq"], r["outcome"], r["text"]) for r in back.collect()) == want
    other = spark.createDataFrame([(9, "zz", None)], asks.schema)
    assert estate.replayed(other, live).collect()[0]["outcome"] == "no-record"


def test_probing_stops_at_the_first_type_that_answers(spark):
    manifest = spark.createDataFrame(
        [(1, "P", "program", "runtime", None, False, None, None), (2, "p", "program", "runtime", None, False, None, None), (3, "Q", "program", "runtime", None, False, None, None)],
        "seq long, artifact string, kind string, dependency string, classification string, dynamic boolean, dataset string, ddname string",
    )
    answers = spark.createDataFrame([(1, "P", "asm", "found", "s", None), (2, "Q", "cobol", "found", "s", "hlasm"), (3, "Q", "asm", "error", None, None)], "seq long, name string, asked_type string, outcome string, source string, detected_type string")
    store = spark.createDataFrame([], "member string, asked_type string, ord long, text string, source string")
    rows = [tuple(r) for r in estate.fetched(estate.fetch_plan(manifest), "X", store, answers).orderBy("seq").select("status", "language", "language_basis", "classification").collect()]
    assert rows == [("fetched", "asm", "probed", "assembler-program"), ("already-fetched", None, None, None), ("fetched", "asm", "detected", "assembler-program")]


def test_rows_that_repeat_their_seq_keep_their_own_answers(spark):
    rows = [(7, n, "program", "runtime", None, False, None, None) for n in ("P", "Q", "P", "P", "R", "P")]
    manifest = spark.createDataFrame(rows, "seq long, artifact string, kind string, dependency string, classification string, dynamic boolean, dataset string, ddname string")
    answers = spark.createDataFrame([(1, "P", "asm", "found", "s", None), (1, "Q", "cobol", "error", None, None)], "seq long, name string, asked_type string, outcome string, source string, detected_type string")
    store = spark.createDataFrame([("R", "cobol", 1, "t", "here")], "member string, asked_type string, ord long, text string, source string")
    found = sorted((r["artifact"], r["status"], r["language"]) for r in estate.fetched(estate.fetch_plan(manifest), "X", store, answers).collect())
    assert found == [("P", "already-fetched", None)] * 3 + [("P", "fetched", "asm"), ("Q", "error", None), ("R", "prefetched", None)]
    asks = spark.createDataFrame([(1, "R", "cobol"), (1, "S", "cobol"), (1, "R", "asm")], "seq long, name string, asked_type string")
    assert sorted((r["name"], r["asked_type"], r["hit"] is not None) for r in estate.stored(asks, store).collect()) == [("R", "asm", False), ("R", "cobol", True), ("S", "cobol", False)]


def test_reachable_ends_in_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "src string, dst string")
    start = spark.createDataFrame([("a",), ("x",), ("z",)], "root string")
    assert sorted((r["root"], r["node"], r["depth"]) for r in reachable(start, edges).collect()) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("x", "x", 0), ("x", "y", 1), ("z", "z", 0)]


def test_members_from_files(spark, tmp_path):
    (tmp_path / "pay.cbl").write_bytes("       DISPLAY 'é'.".encode("latin-1"))
    (tmp_path / "Tax.cpy").write_bytes("       01 É PIC X.".encode())
    found = {r["member"]: r for r in read_members(spark, str(tmp_path), "program").collect()}
    assert found["PAY"]["text"] == "       DISPLAY 'é'." and found["TAX"]["text"] == "       01 É PIC X." and found["PAY"]["source_name"] == "pay.cbl"


def test_library_rank_and_missing_copybooks(spark):
    library = spark.createDataFrame([("a", "       01 LATE PIC X.\n", "l2", 2), ("A", "       01 EARLY PIC X.\n", "l1", 1)], "member string, text string, source string, rank int")
    ranked = cobol.ranked_library(library, ["rank"])
    text = "       IDENTIFICATION DIVISION.\n       DATA DIVISION.\n       COPY A.\n       COPY B.\n       PROCEDURE DIVISION.\n           GOBACK.\n"
    programs = cobol.parsed(spark.createDataFrame([("P", text), ("Q", None)], "member string, text string"), ranked)
    assert [r["name"] for r in cobol.data_items(programs).collect()] == ["EARLY"]
    assert sorted((r["copy_member"], r["status"], r["source"]) for r in cobol.copybooks(programs).collect()) == [("A", "expanded", "l1"), ("B", "missing", None)]
    assert cobol.program_units(programs).count() == 2
    assert cobol.bundles(programs).filter(F.col("bundle").endswith("}\n")).count() == 2


def test_names_and_types_of_saved_members(spark):
    from millrace.sources.members import saved_name, type_disagreement

    df = spark.createDataFrame([("A/B C", "HLASM", "asm"), ("É$1", None, "cobol"), ("X", "copybook", "cbl")], "m string, t string, d string")
    rows = df.select(saved_name(F.col("m"), F.col("t")).alias("n"), type_disagreement(F.col("t"), F.col("d")).alias("differs")).collect()
    assert [tuple(r) for r in rows] == [("A_B_C.asm", False), ("É$1.txt", None), ("X.cpy", True)]


def test_statements_of_an_external_parser(spark, tmp_path):
    from millrace.sources.members import external_statements

    (tmp_path / "P.xml").write_text('<tree><statement from-line="2" kind="move"><x/></statement><statement kind="none"/><statement from-line="3" kind="stop"/></tree>')
    rendered = spark.createDataFrame([("P", 2, "BOOK", 7), ("P", 3, "P", 9)], "source string, rendered_line int, member string, line int")
    assert sorted(map(tuple, external_statements(spark, str(tmp_path), rendered).collect())) == [("BOOK", 7, "move"), ("P", 9, "stop")]


def test_services_of_any_signature_and_shape(spark, tmp_path):
    (tmp_path / "P.cpy").write_text("from a file")

    def service(name, *, type):  # takes no copy
        return {"A": f"as {type}", "P": tmp_path / "P.cpy", "GONE": tmp_path / "none", "L": ["t", None], "E": []}[name]

    asks = spark.createDataFrame([(3, "E", "asm"), (1, "A", "cobol"), (2, "P", "asm"), (4, "GONE", "asm"), (5, "L", "asm")], "seq long, name string, asked_type string")
    found = retrieval.ask_service(asks, service, jobs=2, copy_to="/somewhere").collect()
    assert [(r["seq"], r["outcome"], r["text"]) for r in found] == [(1, "found", "as cobol"), (2, "found", "from a file"), (3, "not-found", None), (4, "not-found", None), (5, "found", "t")]
    assert retrieval.ask_service(asks.filter("seq = 1"), lambda name: "plain").first()["text"] == "plain"
    assert retrieval.advice(service) == ["copy"] and retrieval.advice(lambda name, **k: 1) == [] and retrieval.advice(lambda name: 1) == ["type", "copy"]
    assert retrieval.loaded("os.path:join")[0] is not None
    assert [retrieval.loaded(x)[0] for x in (None, "os", "os:nothing", "no.such.module:f")] == [None] * 4


def test_answers_are_asked_for_once(spark, tmp_path):
    log = tmp_path / "log"

    def service(name, kind):
        with open(log, "a") as f:
            f.write(name + "\n")
        return name

    asks = spark.createDataFrame([(i, f"M{i}", None) for i in range(5)], "seq long, name string, asked_type string")
    answers = retrieval.ask_service(asks, service, jobs=2)
    assert answers.count() == answers.filter("outcome = 'found'").count() == 5
    assert len(log.read_text().split()) == 5


def test_retrieval_goes_on_until_nothing_is_missing(spark):
    texts = {"A": "       COPY B.\n       COPY C.\n", "B": "       COPY D.\n", "D": "       COPY A.\n       COPY LOST.\n"}
    asked = []

    def service(name, type=None):
        if name == "LOST":
            raise OSError("down")
        return texts.get(name)

    def ask(asks):
        asked.append(sorted(r["name"] for r in asks.collect()))
        return retrieval.ask_service(asks, service)

    start = spark.createDataFrame([("a",), ("no name",), ("OWN",)], "member string")
    local = spark.createDataFrame([("own", "       COPY C.\n", "here")], "member string, text string, source string")
    found = retrieval.closed(start, local, cobol.copy_edges, ask)
    want = [("A", 0, "fetched"), ("B", 1, "fetched"), ("C", 1, "not-found"), ("D", 2, "fetched"), ("LOST", 3, "error"), ("NO NAME", 0, "skipped"), ("OWN", 0, "local")]
    assert sorted((r["member"], r["level"], r["status"]) for r in found.collect()) == want
    assert asked == [["A"], ["B", "C"], ["D"], ["LOST"]]
    assert {r["status"] for r in retrieval.closed(start, local, cobol.copy_edges, None).collect()} == {"no-service", "skipped", "local"}
    rows = spark.createDataFrame([("A", "cobol", "not-found"), ("A", "asm", "fetched"), ("B", "asm", "error")], "member string, asked_type string, status string")
    assert sorted((r["status"], r["n"], r["missing"]) for r in retrieval.report(rows).collect()) == [("error", 1, ["B"]), ("fetched", 1, []), ("not-found", 1, ["A (cobol)"])]


def test_a_resolver_that_misbehaves_is_asked_no_more(spark):
    def service(name):
        if name == "M":
            return 7
        return {"A": " base ", "B": None}.get(name, "X")

    names = spark.createDataFrame([(x,) for x in "abmzk"], "name string")
    mapping = spark.createDataFrame([("k", "kept")], "name string, base string")
    found = {r["name"]: (r["base"], r["door"], r["reason"] is not None) for r in retrieval.resolved(names, mapping, service).collect()}
    assert found == {"A": ("BASE", "resolver", False), "B": (None, None, False), "M": (None, None, True), "Z": (None, None, True), "K": ("KEPT", "map", False)}


def test_recorded_dependents_replay(spark):
    def service(name):
        return {"A": [{"name": "p", "kind": "JOB"}], "B": [], "C": None, "D": 5}.get(name) if name != "E" else 1 / 0

    asks = spark.createDataFrame([(i, n, "program") for i, n in enumerate("ABCDE")], "seq long, name string, kind string")
    answers = retrieval.ask_dependents(asks, service, jobs=2)
    assert [r["outcome"] for r in answers.collect()] == ["answered", "answered", "not-covered", "unreadable", "error"]
    back = {r["name"]: (r["answer_status"], r["rows"] and len(r["rows"])) for r in estate.dependents(asks, *retrieval.recorded(answers)).collect()}
    assert back == {"A": ("answered", 1), "B": ("answered", []), "C": ("not-answered", None), "D": ("not-answered", None), "E": ("not-answered", None)}
