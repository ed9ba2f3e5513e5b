"""What a Python worker hands on at a time is bounded, however much a task has to read."""

import pyarrow as pa
from pyspark.sql import types as T

from millrace.functions.shipping import BATCH_ROWS
from millrace.operators import cics, cobol


def test_macros_of_one_batch_leave_in_pieces_in_order():
    lines = [f"L{i} DFHFCT TYPE" for i in range(3000)]
    batch = pa.RecordBatch.from_pydict({"member": ["A", "B", "C"], "lines": [lines, None, lines]})
    out = list(cics._macros(1, iter([batch])))
    assert len(out) > 1 and max(x.num_rows for x in out) <= BATCH_ROWS
    assert [(r["member"], r["label"]) for x in out for r in x.to_pylist()] == [(m, f"L{i}") for m in "AC" for i in range(3000)]


def test_macro_decks_are_dealt_by_their_text(spark):
    from millrace.sources.members import WORK_BYTES

    rows = spark.range(6, numPartitions=1).selectExpr("concat('M', id) AS member", f"repeat('L DFHFCT TYPE\\n', {WORK_BYTES // 28}) AS text")
    assert cics.macros(rows).rdd.getNumPartitions() >= 3


def test_tokens_of_one_batch_leave_in_pieces_in_order(spark):
    texts = [f"           MOVE A TO B{i}.\n" * 400 for i in range(6)]
    batch = pa.RecordBatch.from_pydict({"member": [f"M{i}" for i in range(6)], "text": texts, "format": ["fixed"] * 6})
    shape = T.StructType.fromDDL("member string, tok_ix int, text string")
    out = list(cobol._flat(cobol._token_rows, ["member", "text", "format"], shape, iter([batch])))
    assert len(out) > 1 and max(x.num_rows for x in out) <= BATCH_ROWS
    found = [(r["member"], r["tok_ix"]) for x in out for r in x.to_pylist()]
    assert found == [(f"M{i}", k) for i in range(6) for k in range(2000)]


def test_a_tree_leaves_before_the_next_member_is_parsed():
    none = pa.nulls(3, pa.list_(pa.struct([("name", pa.string())])))
    source = "       PROCEDURE DIVISION.\n       P1.\n           GOBACK.\n"
    batch = pa.RecordBatch.from_pydict({"member": ["A", "B", "C"], "format": ["fixed"] * 3, "source_name": ["A", "B", "C"], "text": [source] * 3, "books": none, "failed": none})
    assert [x["member"].to_pylist() for x in cobol._parse(iter([batch]))] == [["A"], ["B"], ["C"]]


def test_a_table_read_off_the_source_equals_the_one_off_its_json(spark):
    text = "       PROCEDURE DIVISION.\n       P1.\n           IF A = 1 READ F AT END GOBACK NOT AT END STOP RUN END-READ.\n       P2.\n           SORT S USING A GIVING B.\n           MOVE 'X' TO B.\n"
    programs = cobol.parsed(spark.createDataFrame([("A", text, "fixed"), ("B", None, "fixed")], "member string, text string, format string"))
    for table in (cobol.statements, cobol.paragraphs, cobol.program_units, cobol.assignments):
        assert table(programs).collect() == table(programs.filter("true")).collect()
    some = cobol.statements(programs, ["member", "branch", "node"])
    assert some.columns == ["member", "branch", "node"] and some.collect() == cobol.statements(programs).select("member", "branch", "node").collect()
