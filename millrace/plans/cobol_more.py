"""Queries over statements, embedded SQL and CICS, program units and declarations, each rendered from a table's rows and read back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.cobol_text import split_outside_literals
from millrace.functions.shipping import ship
from millrace.operators import cobol
from millrace.plans.cobol import DATA, ID, PROC, area_a, card
from millrace.plans.render import bucket, members, table
from millrace.registry import Registry

REGISTRY = Registry()
K = "c_custkey"


def programs(spark: SparkSession, sf_dir: str, text: Column, head: str, tail: str = "") -> DataFrame:
    """Parsed programs of a hundred customers each, every customer's text between head and tail."""
    rows = table(spark, sf_dir, "customer")
    return cobol.parsed(members(rows, bucket(F.col(K), 100, "C"), F.col(K), text, head=head, tail=tail).withColumn("format", F.lit("fixed")))


def one_each(spark: SparkSession, sf_dir: str, text: Column) -> DataFrame:
    """Parsed programs, one a supplier."""
    rows = table(spark, sf_dir, "supplier").select(F.format_string("S%d", "s_suppkey").alias("member"), text.alias("text"), F.lit("fixed").alias("format"))
    return cobol.parsed(rows)


def stmts(spark: SparkSession, sf_dir: str, *lines: str) -> DataFrame:
    """The statements of a paragraph a customer; %1$d in the lines is its key."""
    text = F.concat(area_a("P-%d.\n", K), F.format_string("\n".join("           " + x for x in lines), K))
    return cobol.statements(programs(spark, sf_dir, text, ID + PROC))


def by_kind(shapes: list[str]) -> Column:
    """A line of one of several shapes, by the customer's key."""
    text = F.lit(None).cast("string")
    for i, x in enumerate(shapes):
        text = F.when(F.pmod(K, F.lit(len(shapes))) == i, F.format_string("           " + x, K)).otherwise(text)
    return text


def attr(name: str, alias: str | None = None) -> Column:
    return F.get_json_object("attrs", f"$.{name}").alias(alias or name)


def listed(name: str, alias: str) -> Column:
    """A list attribute joined by commas."""
    return F.array_join(F.from_json(F.get_json_object("attrs", f"$.{name}"), "array<string>"), ",").alias(alias)


@REGISTRY.query(
    "cobol_string_unstring",
    """SELECT 'STRING' AS verb, concat('STRING A-', c_custkey, ' DELIMITED BY SIZE INTO G ON OVERFLOW DISPLAY ''O'' END-STRING') AS text FROM customer
UNION ALL SELECT 'UNSTRING', concat('UNSTRING G DELIMITED BY '','' INTO A-', c_custkey) FROM customer""",
)
def string_unstring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stmts(spark, sf_dir, "STRING A-%1$d DELIMITED BY SIZE INTO G", "  ON OVERFLOW DISPLAY 'O' END-STRING", "UNSTRING G DELIMITED BY ',' INTO A-%1$d.")
    return found.select("verb", "text")


@REGISTRY.query("cobol_search", "SELECT concat('T-', c_custkey) AS tbl, 'true' AS every, concat('K = ', c_custkey) AS condition FROM customer")
def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stmts(spark, sf_dir, "SEARCH ALL T-%1$d AT END DISPLAY 'N'", "  WHEN K = %1$d MOVE 1 TO Y END-SEARCH.")
    heads = found.filter("node = 'SearchStmt'").select("member", "paragraph", "stmt_id", attr("table", "tbl"), attr("all", "every"))
    whens = found.filter("branch = 'when[0]'").select("member", "paragraph", F.col("parent_id").alias("stmt_id"), "condition")
    return heads.join(whens, ["member", "paragraph", "stmt_id"]).select("tbl", "every", "condition")


@REGISTRY.query(
    "cobol_perform_kinds",
    """SELECT concat('P-', c_custkey) AS paragraph, CASE c_custkey % 4 WHEN 0 THEN 'times' WHEN 1 THEN 'until' WHEN 2 THEN 'varying' ELSE 'call' END AS kind,
  CASE WHEN c_custkey % 4 IN (0, 1, 3) THEN concat('Q-', c_custkey) END AS target, CASE WHEN c_custkey % 4 = 3 THEN concat('R-', c_custkey) END AS thru FROM customer""",
)
def perform_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = ["PERFORM Q-%1$d 5 TIMES.", "PERFORM Q-%1$d UNTIL X = 1.", "PERFORM VARYING I FROM 1 BY 1 UNTIL I > 3\n             ADD 1 TO X END-PERFORM.", "PERFORM Q-%1$d THRU R-%1$d."]
    found = cobol.statements(programs(spark, sf_dir, F.concat(area_a("P-%d.\n", K), by_kind(shapes)), ID + PROC)).filter("node = 'PerformStmt'")
    return found.select("paragraph", attr("kind"), attr("target"), attr("thru"))


@REGISTRY.query(
    "cobol_go_to",
    """SELECT concat('P-', c_custkey) AS paragraph, CASE WHEN c_custkey % 2 = 0 THEN concat('A-', c_custkey, ',B-', c_custkey) ELSE concat('A-', c_custkey) END AS targets,
  CASE WHEN c_custkey % 2 = 0 THEN 'X' END AS item FROM customer""",
)
def go_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(area_a("P-%d.\n", K), by_kind(["GO TO A-%1$d B-%1$d DEPENDING ON X.", "GO TO A-%1$d."]))
    found = cobol.statements(programs(spark, sf_dir, text, ID + PROC)).filter("node = 'GoToStmt'")
    return found.select("paragraph", listed("targets", "targets"), attr("depending_on", "item"))


@REGISTRY.query("cobol_alter", "SELECT concat('A-', c_custkey) AS source, concat('B-', c_custkey) AS target FROM customer")
def alter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stmts(spark, sf_dir, "ALTER A-%1$d TO PROCEED TO B-%1$d.").filter("node = 'AlterStmt'")
    pairs = F.explode(F.from_json(F.get_json_object("attrs", "$.pairs"), "array<array<string>>")).alias("p")
    return found.select(pairs).select(F.col("p")[0].alias("source"), F.col("p")[1].alias("target"))


@REGISTRY.query(
    "cobol_sort_merge",
    """SELECT concat('P-', c_custkey) AS paragraph, CASE WHEN c_custkey % 3 = 2 THEN 'MERGE' ELSE 'SORT' END AS verb, concat('S-', c_custkey) AS file,
  CASE c_custkey % 3 WHEN 0 THEN concat('A-', c_custkey) WHEN 1 THEN '' ELSE concat('A-', c_custkey, ',B-', c_custkey) END AS inputs,
  CASE WHEN c_custkey % 3 = 1 THEN concat('I-', c_custkey) END AS input_proc FROM customer""",
)
def sort_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = [
        "SORT S-%1$d ON ASCENDING KEY K\n             USING A-%1$d GIVING Z.", "SORT S-%1$d DESCENDING KEY K\n             INPUT PROCEDURE I-%1$d THRU J GIVING Z.",
        "MERGE S-%1$d ASCENDING KEY K\n             USING A-%1$d B-%1$d GIVING Z.",
    ]
    found = cobol.statements(programs(spark, sf_dir, F.concat(area_a("P-%d.\n", K), by_kind(shapes)), ID + PROC)).filter("node = 'SortStmt'")
    return found.select("paragraph", "verb", attr("file"), listed("using", "inputs"), attr("input_proc"))


@REGISTRY.query(
    "cobol_io_statements",
    """SELECT concat('P-', c_custkey) AS paragraph, CASE c_custkey % 5 WHEN 0 THEN 'READ' WHEN 1 THEN 'WRITE' WHEN 2 THEN 'REWRITE' WHEN 3 THEN 'DELETE' ELSE 'START' END AS verb,
  concat('F-', c_custkey) AS file, CASE WHEN c_custkey % 5 = 0 THEN 'W' END AS into, CASE WHEN c_custkey % 5 IN (1, 2) THEN 'W' END AS origin FROM customer""",
)
def io_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = ["READ F-%1$d NEXT RECORD INTO W.", "WRITE F-%1$d FROM W.", "REWRITE F-%1$d FROM W\n             INVALID KEY DISPLAY 'X' END-REWRITE.", "DELETE F-%1$d RECORD.", "START F-%1$d KEY IS EQUAL K."]
    found = cobol.statements(programs(spark, sf_dir, F.concat(area_a("P-%d.\n", K), by_kind(shapes)), ID + PROC)).filter("node = 'IoStmt'")
    return found.select("paragraph", "verb", attr("file"), attr("into"), attr("from_", "origin"))


@REGISTRY.query("cobol_size_errors", "SELECT 'COMPUTE' AS verb, 'ON_SIZE_ERROR' AS handler, count(*)::BIGINT AS n FROM customer GROUP BY 1, 2")
def size_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stmts(spark, sf_dir, "COMPUTE X-%1$d = 1 + 2", "  ON SIZE ERROR DISPLAY 'E' END-COMPUTE.")
    inner = found.filter("branch = 'inner'").select("member", "paragraph", "parent_id", "verb")
    caught = found.filter("branch LIKE 'ON%'").select("member", "paragraph", "parent_id", F.col("branch").alias("handler"))
    return inner.join(caught, ["member", "paragraph", "parent_id"]).groupBy("verb", "handler").agg(F.count("*").alias("n"))


@REGISTRY.query(
    "cobol_call_operands",
    """SELECT CASE WHEN c_custkey % 2 = 0 THEN concat('SUB', c_custkey) ELSE 'WS-PGM' END AS target, (c_custkey % 2 = 1)::VARCHAR AS dynamic, concat('A-', c_custkey, ',B') AS operands, 'R' AS returned FROM customer""",
)
def call_operands(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(area_a("P-%d.\n", K), by_kind(["CALL 'SUB%1$d' USING A-%1$d\n             BY CONTENT B RETURNING R.", "CALL WS-PGM USING A-%1$d B RETURNING R."]))
    found = cobol.statements(programs(spark, sf_dir, text, ID + PROC)).filter("node = 'CallStmt'")
    return found.select(attr("target"), attr("dynamic"), listed("using", "operands"), attr("returning", "returned"))


@REGISTRY.query(
    "cobol_exec_cics",
    """SELECT concat('P-', c_custkey) AS paragraph, CASE c_custkey % 4 WHEN 0 THEN 'call' WHEN 1 THEN 'transfer' WHEN 2 THEN 'handle' ELSE 'terminate' END AS kind,
  CASE c_custkey % 4 WHEN 0 THEN concat('PGM', c_custkey) WHEN 1 THEN 'WS-PGM' END AS target, CASE WHEN c_custkey % 4 = 2 THEN concat('NOTFND,Q-', c_custkey) ELSE '' END AS conditions FROM customer""",
)
def exec_cics(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = [
        "EXEC CICS LINK PROGRAM('PGM%1$d')\n             COMMAREA(C) END-EXEC.", "EXEC CICS XCTL PROGRAM(WS-PGM) END-EXEC.", "EXEC CICS HANDLE CONDITION NOTFND(Q-%1$d)\n             END-EXEC.",
        "EXEC CICS RETURN TRANSID('T%1$d') END-EXEC.",
    ]
    found = cobol.statements(programs(spark, sf_dir, F.concat(area_a("P-%d.\n", K), by_kind(shapes)), ID + PROC)).filter("node = 'ExecStmt'")
    return found.select("paragraph", attr("kind"), attr("target"), listed("conditions", "conditions"))


@REGISTRY.query(
    "cobol_sql_insert",
    "SELECT c AS col, concat(h, c_custkey) AS host_var FROM customer, (VALUES ('C_NAME', 'N-'), ('C_BAL', 'B-')) AS x(c, h)",
)
def sql_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string("           EXEC SQL INSERT INTO OWN.T (C_NAME, C_BAL, C_X)\n             VALUES (:N-%1$d, :B-%1$d, 5) END-EXEC.", K)
    return cobol.exec_columns(programs(spark, sf_dir, text, ID + PROC)).filter("host_var IS NOT NULL").select(F.col("column").alias("col"), "host_var")


@REGISTRY.query("cobol_sql_group_insert", "SELECT concat('G', c_custkey, '-', p) AS host_var, c AS col FROM customer, (VALUES ('A', 'C_A'), ('B', 'C_B')) AS x(p, c)")
def sql_group_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group as host variable stands for its items."""
    rows = table(spark, sf_dir, "customer")
    text = F.concat(
        F.lit(DATA), F.format_string("       01 G%1$d.\n          05 G%1$d-A PIC X.\n          05 FILLER PIC X.\n          05 G%1$d-B PIC 9.\n", K), F.lit(PROC),
        card("EXEC SQL INSERT INTO T (C_A, C_B) VALUES (:G%1$d)\n             END-EXEC.", K),
    )
    parsed = cobol.parsed(rows.select(F.col(K).cast("string").alias("member"), text.alias("text"), F.lit("fixed").alias("format")))
    return cobol.exec_columns(parsed).select("host_var", F.col("column").alias("col"))


@REGISTRY.query("cobol_sql_update", "SELECT concat('C', c_custkey) AS col, concat('H', c_custkey) AS host_var FROM customer")
def sql_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string("           EXEC SQL UPDATE T SET C%1$d = :H%1$d, D = D + 1\n             WHERE E = :W END-EXEC.", K)
    return cobol.exec_columns(programs(spark, sf_dir, text, ID + PROC)).filter("host_var IS NOT NULL").select(F.col("column").alias("col"), "host_var")


@REGISTRY.query(
    "cobol_sql_unresolved",
    """SELECT concat('P-', c_custkey) AS paragraph, CASE c_custkey % 4 WHEN 0 THEN 'count-mismatch' WHEN 1 THEN 'insert-from-fullselect' WHEN 2 THEN 'values-unparseable' ELSE 'common-table-expression' END AS why FROM customer""",
)
def sql_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = [
        "EXEC SQL INSERT INTO T (A, B) VALUES (:X, :Y, :Z) END-EXEC.", "EXEC SQL INSERT INTO T (A, B) SELECT P, Q FROM S END-EXEC.", "EXEC SQL INSERT INTO T (A, B) VALUES :X END-EXEC.",
        "EXEC SQL WITH C AS (SELECT A FROM T) SELECT A INTO :X FROM C\n             END-EXEC.",
    ]
    found = cobol.statements(programs(spark, sf_dir, F.concat(area_a("P-%d.\n", K), by_kind(shapes)), ID + PROC)).filter("node = 'ExecStmt'")
    return found.select("paragraph", attr("column_unresolved", "why"))


@REGISTRY.query("cobol_cursors", "SELECT concat('C', c_custkey) AS cursor, concat('OWN.T', c_custkey) AS tbl, 'A,B' AS columns, 'select' AS kind FROM customer")
def cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string("           EXEC SQL DECLARE C%1$d CURSOR WITH HOLD FOR\n             SELECT A, B FROM OWN.T%1$d WHERE K = :K END-EXEC.", K)
    found = cobol.sql_cursors(programs(spark, sf_dir, text, DATA, "\n" + PROC + "           GOBACK."))
    return found.select("cursor", F.col("table").alias("tbl"), F.array_join("columns", ",").alias("columns"), F.col("for_kind").alias("kind"))


@REGISTRY.query("cobol_fetch_columns", "SELECT concat('H', s_suppkey) AS host_var, 'A' AS col FROM supplier UNION ALL SELECT concat('I', s_suppkey), 'B' FROM supplier")
def fetch_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a FETCH fills is what its cursor selects."""
    key = F.col("s_suppkey")
    text = F.concat(
        F.lit(DATA), F.format_string("           EXEC SQL DECLARE C%1$d CURSOR FOR\n             SELECT A, B FROM T END-EXEC.\n", key), F.lit(PROC),
        F.format_string("           EXEC SQL FETCH NEXT FROM C%1$d\n             INTO :H%1$d, :I%1$d END-EXEC.", key),
    )
    parsed = one_each(spark, sf_dir, text)
    fetches = cobol.statements(parsed).filter("node = 'ExecStmt' AND verb = 'FETCH'").select("member", attr("cursor"), F.from_json(F.get_json_object("attrs", "$.into_vars"), "array<string>").alias("vars"))
    selected = cobol.sql_cursors(parsed).select("member", F.col("cursor"), "columns")
    pairs = fetches.join(selected, ["member", "cursor"]).select(F.explode(F.arrays_zip("vars", "columns")).alias("x"))
    return pairs.select(F.col("x.vars").alias("host_var"), F.col("x.columns").alias("col"))


@REGISTRY.query("cobol_declared_tables", "SELECT concat('OWN.T', s_suppkey) AS tbl, concat('K', s_suppkey, ',NAME') AS columns FROM supplier")
def declared_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit(DATA), F.format_string("           EXEC SQL DECLARE OWN.T%1$d TABLE\n             (K%1$d INTEGER NOT NULL, NAME CHAR(9)) END-EXEC.\n", "s_suppkey"), F.lit(PROC + "           GOBACK.\n"))
    shape = "array<struct<table:string,columns:array<string>>>"
    found = one_each(spark, sf_dir, text).select(F.explode(F.from_json(F.get_json_object("program", "$.declared_tables"), shape)).alias("x"))
    return found.select(F.col("x.table").alias("tbl"), F.array_join("x.columns", ",").alias("columns"))


@REGISTRY.query(
    "cobol_contained_programs",
    "SELECT concat('S', s_suppkey) AS member, 0 AS unit, concat('OUT', s_suppkey) AS program_id FROM supplier UNION ALL SELECT concat('S', s_suppkey), 1, concat('IN', s_suppkey) FROM supplier",
)
def contained_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    begin = "       IDENTIFICATION DIVISION.\n"
    text = F.concat(
        F.lit(begin), F.format_string("       PROGRAM-ID. OUT%d.\n", key), F.lit(PROC + "           GOBACK.\n" + begin), F.format_string("       PROGRAM-ID. 'IN%1$d'.\n", key), F.lit(PROC + "           GOBACK.\n"), F.format_string("       END PROGRAM IN%1$d.\n       END PROGRAM OUT%1$d.\n", key),
    )
    return cobol.program_units(one_each(spark, sf_dir, text)).select("member", "unit", "program_id")


@REGISTRY.query("cobol_program_names", "SELECT concat('S', s_suppkey) AS member, CASE s_suppkey % 3 WHEN 0 THEN concat('N', s_suppkey) WHEN 1 THEN concat('N', s_suppkey) ELSE 'RECOVERED' END AS program_id FROM supplier")
def program_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name on its own line, on the next one, and none at all."""
    key = F.col("s_suppkey")
    named = F.when(key % 3 == 0, F.format_string("       PROGRAM-ID. N%d IS INITIAL.\n", key)).when(key % 3 == 1, F.format_string("       PROGRAM-ID.\n           N%d.\n", key)).otherwise("       PROGRAM-ID.\n       AUTHOR.\n")
    text = F.concat(F.lit("       IDENTIFICATION DIVISION.\n"), named, F.lit(PROC + "           GOBACK.\n"))
    return cobol.program_units(one_each(spark, sf_dir, text)).select("member", "program_id")


@REGISTRY.query("cobol_interfaces", "SELECT concat('L', s_suppkey, ',M') AS operands, concat('R', s_suppkey) AS returned FROM supplier")
def interfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit(ID), F.format_string("       PROCEDURE DIVISION USING BY REFERENCE L%1$d, BY VALUE M\n           RETURNING R%1$d.\n           GOBACK.\n", "s_suppkey"))
    return cobol.program_units(one_each(spark, sf_dir, text)).select(F.array_join("using", ",").alias("operands"), F.col("returning").alias("returned"))


@REGISTRY.query(
    "cobol_declaratives",
    "SELECT concat('D-', s_suppkey) AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'ERROR' ELSE 'EXCEPTION' END AS use_trigger, CASE WHEN s_suppkey % 2 = 0 THEN concat('F-', s_suppkey) ELSE '' END AS files FROM supplier",
)
def declaratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    use = F.when(key % 2 == 0, F.format_string("           USE AFTER STANDARD ERROR PROCEDURE ON F-%d.\n", key)).otherwise("           USE GLOBAL AFTER EXCEPTION PROCEDURE ON INPUT.\n")
    text = F.concat(
        F.lit(ID + PROC + "       DECLARATIVES.\n"), F.format_string("       D-%d SECTION.\n", key), use, F.lit("       D-P. DISPLAY 'X'.\n       END DECLARATIVES.\n       M-1.\n           GOBACK.\n"),
    )
    found = cobol.paragraphs(one_each(spark, sf_dir, text)).filter("region = 'declaratives' AND is_section")
    return found.select("name", "use_trigger", F.array_join("use_files", ",").alias("files"))


@REGISTRY.query(
    "cobol_file_control",
    "SELECT concat('DD', s_suppkey) AS assign, 'INDEXED' AS organization, 'DYNAMIC' AS access, concat('K-', s_suppkey) AS key, concat('S-', s_suppkey) AS status FROM supplier",
)
def file_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = "           SELECT OPTIONAL F-1 ASSIGN TO DD%1$d\n             ORGANIZATION IS INDEXED ACCESS MODE IS DYNAMIC\n             RECORD KEY IS K-%1$d FILE STATUS IS S-%1$d.\n"
    text = F.concat(F.lit(ID + "       ENVIRONMENT DIVISION.\n       INPUT-OUTPUT SECTION.\n       FILE-CONTROL.\n"), F.format_string(entry, "s_suppkey"), F.lit(PROC + "           GOBACK.\n"))
    at = lambda k, alias: F.get_json_object("program", f"$.files.F-1.{k}").alias(alias)
    return one_each(spark, sf_dir, text).select(at("assign", "assign"), at("organization", "organization"), at("access", "access"), at("recordKey", "key"), at("statusField", "status"))


@REGISTRY.query("cobol_data_records", "SELECT concat('R-', s_suppkey, ',Q-', s_suppkey) AS records FROM supplier")
def data_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = "       FD  F-1 LABEL RECORDS ARE STANDARD\n           DATA RECORDS ARE R-%1$d Q-%1$d.\n       01  R-%1$d PIC X(10).\n"
    text = F.concat(F.lit(ID + "       DATA DIVISION.\n       FILE SECTION.\n"), F.format_string(entry, "s_suppkey"), F.lit(PROC + "           GOBACK.\n"))
    found = F.from_json(F.get_json_object("program", "$.fd_data_records.F-1"), "array<string>")
    return one_each(spark, sf_dir, text).select(F.array_join(found, ",").alias("records"))


@REGISTRY.query(
    "cobol_qualified_paragraphs",
    """SELECT concat('WORK_OF_A', s_suppkey) AS name, concat('DONE_OF_A', s_suppkey) AS target FROM supplier
UNION ALL SELECT concat('WORK_OF_B', s_suppkey), concat('DONE_OF_B', s_suppkey) FROM supplier""",
)
def qualified_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs that two sections have, and the references of each section."""
    section = "       {0}%1$d SECTION.\n       WORK.\n           PERFORM DONE.\n       DONE.\n           EXIT.\n"
    text = F.concat(F.lit(ID + PROC), F.format_string(section.format("A") + section.format("B"), "s_suppkey"))
    found = cobol.statements(one_each(spark, sf_dir, text)).filter("node = 'PerformStmt'")
    return found.select(F.col("paragraph").alias("name"), attr("target"))


@REGISTRY.query("cobol_replace_statement", "SELECT concat('N', s_suppkey, '-', p) AS name FROM supplier, (VALUES ('A'), ('B')) AS x(p) UNION ALL SELECT 'LAST' FROM supplier")
def replace_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REPLACE holds until REPLACE OFF; listing directives and compiler cards are no code."""
    body = "       REPLACE ==:T:== BY ==N%1$d==.\n       01 :T:-A PIC X.\n           EJECT\n       01 :T:-B PIC X VALUE ':T:'.\n           SKIP2\n           TITLE 'PAGE'.\n       REPLACE OFF.\n       01 LAST PIC X.\n"
    text = F.concat(F.lit("       CBL RENT,LIST\n       PROCESS NOSEQ\n" + DATA), F.format_string(body, "s_suppkey"), F.lit(PROC + "           GOBACK.\n"))
    return cobol.data_items(one_each(spark, sf_dir, text)).select("name")


@REGISTRY.query("cobol_free_format", "SELECT concat('MOVE ''*> no remark'' TO W', c_custkey, '.') AS code FROM customer")
def free_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    text = F.concat(F.lit("* remark\n"), F.format_string("MOVE '*> no remark' TO W%d. *> a remark", K), F.lit("\n\n"))
    found = cobol.code_lines(members(rows, bucket(F.col(K), 100, "C"), F.col(K), text, head="IDENTIFICATION DIVISION.\n").withColumn("format", F.lit("free")))
    return found.filter("text LIKE 'MOVE%'").select(F.trim("text").alias("code"))


@REGISTRY.query("cobol_copy_failures", "SELECT concat('P', n_nationkey) AS member, concat('C', n_nationkey) AS copybook, 'TimeoutError: down' AS error FROM nation WHERE n_nationkey % 2 = 1")
def copy_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copybooks whose retrieval failed, beside the programs that miss them; others are in the library."""
    n = table(spark, sf_dir, "nation")
    text = F.concat(F.lit(DATA), F.format_string("           COPY C%d.\n", "n_nationkey"), F.lit(PROC + "           GOBACK.\n"))
    book = F.format_string("C%d", "n_nationkey").alias("member")
    library = n.filter("n_nationkey % 2 = 0").select(book, F.lit("       01 X PIC X.\n").alias("text"), F.lit("lib").alias("source"))
    errors = n.filter("n_nationkey % 2 = 1").select(book, F.lit("TimeoutError: down").alias("error"))
    found = cobol.parsed(n.select(F.format_string("P%d", "n_nationkey").alias("member"), text.alias("text")), library, errors)
    return found.select("member", F.explode("copybook_errors").alias("x")).select("member", F.col("x")[0].alias("copybook"), F.col("x")[1].alias("error"))


@REGISTRY.query("split_outside_literals", "SELECT c_custkey, concat('''A TO B', c_custkey, '''') AS before, concat('X', c_custkey) AS behind FROM customer")
def split_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)

    @F.pandas_udf("struct<before:string,behind:string>")
    def split(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([split_outside_literals(x, "TO") for x in texts], columns=["before", "behind"])

    rows = table(spark, sf_dir, "customer").select("c_custkey", split(F.format_string("'A TO B%1$d' to X%1$d", K)).alias("x"))
    return rows.select("c_custkey", "x.before", "x.behind")
