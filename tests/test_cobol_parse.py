import json
import textwrap

import pytest

from millrace.functions import cobol_data as cd
from millrace.functions import cobol_parse as cp
from millrace.functions import cobol_rows as cr
from millrace.functions import cobol_sql as sql
from millrace.functions import cobol_text as ct

HEAD = "       IDENTIFICATION DIVISION.\n       PROGRAM-ID. P.\n"


def indented(text):
    lines = (y for x in text.split("\n") for y in textwrap.wrap(x, 58, break_on_hyphens=False, break_long_words=False))
    return "".join(f"           {x}\n" for x in lines)


def statements(code):
    p = cp.program(HEAD + "       PROCEDURE DIVISION.\n       MAIN-PARA.\n" + indented(code), True)
    assert [x["parse_error"] for x in p["paragraphs"]] == [None] * len(p["paragraphs"])
    return p["paragraphs"][0]["statements"]


def first(code):
    return statements(code)[0]


def items(text):
    return cd.data_items(ct.logical_lines(HEAD + "       DATA DIVISION.\n       WORKING-STORAGE SECTION.\n" + text, True))


def test_else_binds_to_the_nearest_if():
    s = first("IF A = 1 IF B = 2 MOVE 1 TO X ELSE MOVE 2 TO X END-IF ELSE MOVE 3 TO X.")
    assert s["cond_text"] == "A = 1" and s["then_body"][0]["else_body"][0]["text"] == "MOVE 2 TO X" and s["else_body"][0]["text"] == "MOVE 3 TO X"


def test_stacked_whens_share_a_body():
    s = first("EVALUATE X WHEN 1 WHEN 2 GOBACK WHEN 3 WHEN OTHER STOP RUN END-EVALUATE.")
    assert [(c, [b["kind"] for b in body]) for c, body in s["whens"]] == [("1", ["GOBACK"]), ("2", ["GOBACK"]), ("3", ["STOP_RUN"])]


@pytest.mark.parametrize(
    ("code", "kind", "target", "thru"),
    [("PERFORM A-1", "call", "A-1", None), ("PERFORM A THRU B 3 TIMES", "times", "A", "B"), ("PERFORM UNTIL X = 1 MOVE 1 TO X END-PERFORM", "until", None, None),
     ("PERFORM N TIMES ADD 1 TO X END-PERFORM", "times", None, None), ("PERFORM A VARYING I FROM 1 BY 1 UNTIL I > 9", "varying", "A", None), ("PERFORM CONTINUE END-PERFORM", "inline", None, None)],
)
def test_perform(code, kind, target, thru):
    s = first(code + ".")
    assert (s["kind"], s["target"], s["thru"]) == (kind, target, thru)


def test_call_arguments_and_handlers():
    s = first("CALL 'SUB' USING A BY CONTENT B C BY REFERENCE D RETURNING R ON EXCEPTION MOVE 1 TO X NOT ON EXCEPTION GOBACK END-CALL.")
    assert (s["target"], s["dynamic"], s["using"], s["by_content"], s["returning"]) == ("SUB", False, ["A", "B", "C", "D"], ["B", "C"], "R")
    assert list(s["handlers"]) == ["ON_EXCEPTION", "NOT_ON_EXCEPTION"] and s["on_exception"]


def test_io_handlers_and_sizes():
    s = first("READ F INTO R AT END MOVE 1 TO E NOT AT END ADD 1 TO N ON SIZE ERROR STOP RUN END-ADD END-READ.")
    assert s["into"] == "R" and list(s["handlers"]) == ["AT_END", "NOT_AT_END"]
    assert s["handlers"]["NOT_AT_END"][0]["t"] == "HandledStmt"
    s = first("WRITE R FROM W INVALID KEY GOBACK NOT INVALID KEY CONTINUE END-WRITE.")
    assert s["from_"] == "W" and list(s["handlers"]) == ["INVALID_KEY", "NOT_INVALID_KEY"]


def test_go_to_alter_exit_sort_search():
    found = statements("GO TO A B OF S DEPENDING ON I.\nALTER A TO PROCEED TO B.\nEXIT PERFORM CYCLE.\nNEXT SENTENCE.\nSORT W ON ASCENDING KEY K INPUT PROCEDURE IS I1 THRU I2 GIVING G.\nSEARCH ALL T AT END STOP RUN WHEN K = 1 WHEN K = 2 GOBACK END-SEARCH.")
    assert (found[0]["targets"], found[0]["depending_on"]) == (["A", "B"], "I")
    assert found[1]["pairs"] == [["A", "B"]] and found[2]["kind"] == "PERFORM_CYCLE" and found[3]["next_sentence"]
    assert (found[4]["file"], found[4]["input_proc"], found[4]["input_thru"], found[4]["giving"]) == ("W", "I1", "I2", ["G"])
    assert found[5]["all"] and found[5]["whens"][0][1] == found[5]["whens"][1][1]


def test_paragraphs_sections_duplicates_and_declaratives():
    src = HEAD + "       PROCEDURE DIVISION USING A BY VALUE B RETURNING C.\n       DECLARATIVES.\n       D-S SECTION.\n           USE AFTER ERROR PROCEDURE ON F1 INPUT.\n       D-P.\n           CONTINUE.\n       END DECLARATIVES.\n"
    src += "       S1 SECTION.\n       P1. PERFORM P2.\n       P2. CONTINUE.\n       S2 SECTION.\n       P2. GO TO P2.\n           DISPLAY 'X\n       NOT-A-HEADER.\n"
    p = cp.program(src, True)
    assert (p["using"], p["returning"]) == (["A", "B"], "C")
    assert [(x["name"], x["section"]) for x in p["paragraphs"]] == [("S1", None), ("P1", "S1"), ("P2_OF_S1", "S1"), ("S2", None), ("P2_OF_S2", "S2"), ("NOT-A-HEADER", "S2")][: len(p["paragraphs"])]
    assert p["paragraphs"][1]["statements"][0]["target"] == "P2_OF_S1"
    assert p["declaratives"][0]["use_trigger"] == "ERROR" and p["declaratives"][0]["use_files"] == ["F1"] and p["declaratives"][0]["statements"] == []


def test_contained_programs():
    src = HEAD + "       PROCEDURE DIVISION.\n           CALL 'IN'.\n       IDENTIFICATION DIVISION.\n       PROGRAM-ID. IN.\n       PROCEDURE DIVISION.\n           GOBACK.\n       END PROGRAM IN.\n       END PROGRAM P.\n"
    p = cp.program(src, True)
    assert p["nested_programs"] == ["IN"] and [x["program_id"] for x in p["contained"]] == ["IN"]
    assert [s["t"] for s in p["paragraphs"][0]["statements"]][0] == "CallStmt"
    assert cp.program(src.replace("       END PROGRAM P.\n", ""), True)["contained"] == []


@pytest.mark.parametrize(
    ("pic", "category", "digits", "scale", "signed"),
    [("X(5)", "alphanumeric", 0, 0, False), ("XX/XX", "alphanumeric-edited", 0, 0, False), ("A(3)", "alphabetic", 0, 0, False), ("S9(4)V99", "numeric", 6, 2, True),
     ("9(3)PP", "numeric", 3, -2, False), ("VPP99", "numeric", 2, 4, False), ("PPP999", "numeric", 3, 3, False), ("ZZ,ZZ9.99", "numeric-edited", 7, 2, False),
     ("-9(3)", "numeric", 3, 0, True), ("9(5)CR", "numeric", 5, 0, True), ("9(5)DB", "numeric-edited", 5, 0, False)],
)
def test_pictures(pic, category, digits, scale, signed):
    kind = cd.pic_type(pic, None)
    assert (kind["category"], kind["digits"], kind["scale"], kind["signed"]) == (category, digits, scale, signed)


def test_data_items():
    found, names, _ = items("       01 G.\n          05 A PIC S9(3) COMP-3 VALUE 1.\n             88 OK VALUES ARE 1 'A' 5 THRU 9.\n          05 T OCCURS 1 TO 9 TIMES DEPENDING ON N\n             PIC X.\n          05 R REDEFINES A PIC X(2).\n       77 N PIC 9.\n")
    by = {x["name"]: x for x in found}
    assert by["A"]["parent"] == "G" and by["A"]["usage"] == "COMP-3" and by["A"]["value"] == "1"
    assert by["OK"]["condition_values"] == ["1", "'A'"] and by["OK"]["condition_ranges"] == [["5", "9"]] and by["OK"]["cond_parent"] == "A"
    assert (by["T"]["occurs"], by["T"]["occurs_depending"], by["R"]["redefines"]) == (9, "N", "A")
    assert cd.host_structure(found, "g") == ["A", "T"] and cd.host_structure(found, "A") is None
    assert cd.spark_type(by["A"]["type"]) == "decimal(3,0)" and names["N"] == len(found) - 1


def block(text):
    return ct.tokens([ct.Line(x, i) for i, x in enumerate(text.split("\n"), 1)])


@pytest.mark.parametrize(
    ("text", "tables"),
    [("SELECT A FROM O.T1 X, T2 WHERE B IN (SELECT C FROM T3)", ["T1", "T2", "T3"]), ("UPDATE T SET A = (SELECT B FROM U)", ["T", "U"]), ("INSERT INTO T SELECT * FROM U JOIN V ON A = B", ["T", "U", "V"]),
     ("MERGE INTO T USING S ON A = B", ["T", "S"]), ("WITH C (X) AS (SELECT 1 FROM T) SELECT X FROM C", ["T"]), ("SELECT A FROM FINAL TABLE (INSERT INTO T VALUES (1))", ["T"]),
     ("SELECT A FROM TABLE(F(1)) X, (T1 LEFT JOIN T2 ON A = B)", ["T1", "T2"]), ("DELETE FROM T WHERE A = :H", ["T"]), ("SELECT TRIM(BOTH FROM A) FROM T", ["T"])],
)
def test_tables_of_statements(text, tables):
    assert sql.table_refs(text) == tables


def test_sql_correlation():
    s = first("EXEC SQL SELECT A, T.B AS C, MAX(D + E), 'x' INTO :H1:I1, :G.H2, :H3 INDICATOR :I3, :H4 FROM O.T END-EXEC.")
    assert s["into_vars"] == ["H1", "H2", "H3", "H4"] and s["indicator_vars"] == ["I1", "I3"] and s["kind"] == "input"
    assert s["columns"][0] == {"column": "A", "hostVar": "H1"} and s["columns"][1] == {"column": "B", "hostVar": "H2"}
    assert s["columns"][2] == {"hostVar": "H3", "derived": True, "expression": "MAX", "derivedFrom": ["D", "E"]}
    assert first("EXEC SQL SELECT A, B INTO :H FROM T END-EXEC.")["column_unresolved"] == "count-mismatch"
    assert first("EXEC SQL INSERT INTO T SELECT * FROM U END-EXEC.")["column_unresolved"] == "insert-from-fullselect"
    s = first("EXEC SQL UPDATE T SET A = :X, B = B + :Y WHERE K = :Z END-EXEC.")
    assert s["columns"] == [{"column": "A", "hostVar": "X"}, {"column": None, "hostVar": "Y", "derived": True, "expression": "expression", "derivedFrom": ["B"]}] and s["where_vars"] == [":Z"]
    s = first("EXEC SQL INSERT INTO O.T VALUES (:A, 1, :B:C) END-EXEC.")
    assert (s["table"], s["values_list"]) == ("O.T", ["A", None, "B"])


def test_cursors_and_declared_tables():
    src = HEAD + "       DATA DIVISION.\n       WORKING-STORAGE SECTION.\n           EXEC SQL DECLARE C1 INSENSITIVE SCROLL CURSOR FOR SELECT A FROM O.T END-EXEC.\n           EXEC SQL DECLARE C2 CURSOR FOR STMT END-EXEC.\n           EXEC SQL DECLARE O.T TABLE (A CHAR(1), B DECIMAL(5,2)) END-EXEC.\n"
    src = src.replace("CURSOR FOR SELECT A FROM O.T", "CURSOR\n             FOR SELECT A FROM O.T").replace("(A CHAR(1), B DECIMAL(5,2))", "\n             (A CHAR(1), B DECIMAL(5,2))")
    p = cp.program(src, True)
    assert [(c["cursor"], c["table"], c["forKind"], c["forStatement"]) for c in p["sql_cursors"]] == [("C1", "O.T", "select", None), ("C2", None, "statement", "STMT")]
    assert [(t["table"], t["columns"]) for t in p["declared_tables"]] == [("O.T", ["A", "B"])]
    assert sql.fetched_cursor(block("FETCH NEXT ROWSET FROM C1 INTO :A")) == "C1"


def test_cics():
    found = statements("EXEC CICS LINK PROGRAM('SUB ') COMMAREA(X) END-EXEC.\nEXEC CICS XCTL PROGRAM(WS-P) END-EXEC.\nEXEC CICS HANDLE CONDITION NOTFND(P1) ERROR(P2) END-EXEC.\nEXEC CICS RETURN END-EXEC.")
    assert [(s["kind"], s["target"], s["dynamic"]) for s in found] == [("call", "SUB", False), ("transfer", "WS-P", True), ("handle", None, False), ("terminate", None, False)]
    assert found[2]["conditions"] == ["NOTFND", "P1", "ERROR", "P2"]


def test_bundles():
    source = HEAD + "       PROCEDURE DIVISION.\n           GOBACK.\n"
    text = cp.bundle_text("P.cbl", source, True, cp.program(source, True))
    assert text.endswith("}\n") and text.isascii() and cp.opened_bundle(text, source)["version"] == 12
    doc = json.loads(text)
    for change in ({"format": "x"}, {"version": 13}, {"program": {"t": "Other"}}):
        with pytest.raises(cp.BundleError):
            cp.opened_bundle(json.dumps(doc | change))
    with pytest.raises(cp.BundleError):
        cp.opened_bundle(text, source + " ")
    doc["program"]["paragraphs"][0]["statements"][0]["t"] = "NewStmt"
    with pytest.raises(cp.BundleError, match="unknown node type"):
        cp.opened_bundle(json.dumps(doc))


def test_statement_rows_follow_the_walk():
    p = cp.program(HEAD + "       PROCEDURE DIVISION.\n       A-P.\n           IF X = 1 GOBACK ELSE STOP RUN END-IF.\n", True)
    rows = list(cr.statement_rows(p))
    assert [(r["path"], r["branch"], r["parent_id"]) for r in rows] == [("0000", None, None), ("0000.then.0000", "then", 0), ("0000.else.0000", "else", 0)]
