"""Queries over COBOL programs rendered from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import cobol
from millrace.plans.render import bucket, members, table
from millrace.registry import Registry
from millrace.sources.members import cobol_lines

REGISTRY = Registry()
ID = "       IDENTIFICATION DIVISION.\n       PROGRAM-ID. MAIN.\n"
DATA = ID + "       DATA DIVISION.\n       WORKING-STORAGE SECTION.\n"
PROC = "       PROCEDURE DIVISION.\n"


def card(text: str, *values) -> Column:
    """A fixed-format line: area B, the pattern's text."""
    return F.concat(F.lit("           "), F.format_string(text, *values))


def area_a(text: str, *values) -> Column:
    return F.concat(F.lit("       "), F.format_string(text, *values))


@REGISTRY.query("cobol_line_split", r"SELECT doc_id, len(regexp_split_to_array(coalesce(text, ''), '\r\n|\r|\n'))::INTEGER AS n_lines FROM documents")
def line_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(cobol_lines(F.coalesce("text", F.lit("")))).alias("n_lines"))


@REGISTRY.query(
    "cobol_format_detect",
    """SELECT concat('M', c_custkey) AS member, CASE c_custkey % 5 WHEN 0 THEN 'free' WHEN 1 THEN 'fixed' WHEN 2 THEN 'free' WHEN 3 THEN 'fixed' ELSE 'free' END AS format,
  CASE c_custkey % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.97 WHEN 2 THEN 0.95 WHEN 3 THEN 0.95 ELSE 0.85 END::DOUBLE AS confidence FROM customer""",
)
def format_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    shapes = [
        ">>SOURCE FORMAT IS FREE\n>>set SOURCEFORMAT\"FREE\"\nDISPLAY 'X'.",
        "      * remark\n       IDENTIFICATION DIVISION.\n\n       PROGRAM-ID. P.",
        "IDENTIFICATION DIVISION.\nPROGRAM-ID. P.\n",
        "       IDENTIFICATION DIVISION.\nlooseXtext\n",
        "MOVE A TO B\n" + "DISPLAY 'a long line of free text'" + " " * 60 + ".\n",
    ]
    text = F.concat(F.get(F.array(*[F.lit(s) for s in shapes]), F.pmod("c_custkey", F.lit(5)).cast("int")), F.lit("\n"))
    found = cobol.format_detection(c.select(F.format_string("M%d", "c_custkey").alias("member"), text.alias("text")))
    return found.select("member", "format", "confidence")


@REGISTRY.query("cobol_fixed_columns", "SELECT concat('DISPLAY ', c_custkey, ' ', c_mktsegment, '.') AS code, count(*)::BIGINT AS n FROM customer GROUP BY 1")
def fixed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    line = F.rpad(F.concat(F.lit("000100     "), F.format_string("DISPLAY %d %s.", "c_custkey", "c_mktsegment")), 72, " ")
    text = F.concat(F.lit("      * remark\n"), line, F.lit("CHANGE01"), F.lit("\n000200D    DISPLAY DEBUG.\n           DISPLAY END. *> not this"))
    found = cobol.code_lines(members(c, bucket(F.col("c_custkey"), 100, "C"), F.col("c_custkey"), text, head="       IDENTIFICATION DIVISION.\n").withColumn("format", F.lit("fixed")))
    return found.select(F.trim("text").alias("code")).filter("code LIKE 'DISPLAY %' AND code <> 'DISPLAY END.'").groupBy("code").agg(F.count("*").alias("n"))


@REGISTRY.query("cobol_continuation_stitch", "SELECT concat('MOVE ''', p_name, ' of ', p_partkey, ''' TO WS-NAME-OF-PART.') AS code FROM part")
def continuation_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A literal cut at column 72 and resumed, and a word resumed without a blank."""
    p = table(spark, sf_dir, "part")
    literal = F.format_string("%s of %d", "p_name", "p_partkey")
    # the open literal goes on to column 72; its part on the first line is a filler that is cut away below
    text = F.concat(F.lit("           MOVE '" + "#" * 55 + "\n      -    '"), literal, F.lit("' TO WS-NAME-OF\n      --PART."))
    found = cobol.code_lines(members(p, bucket(F.col("p_partkey"), 200, "P"), F.col("p_partkey"), text).withColumn("format", F.lit("fixed")))
    return found.select(F.regexp_replace(F.trim("text"), "#", "").alias("code"))


@REGISTRY.query(
    "cobol_tokens_by_kind",
    """WITH n AS (SELECT count(*)::BIGINT AS n FROM part)
SELECT kind, (k * n)::BIGINT AS tokens FROM n, (VALUES ('word', 4), ('number', 1), ('string', 1), ('punct', 3), ('period', 1)) AS t(kind, k)""",
)
def tokens_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    text = card("IF A-%d >= %s MOVE 'it''s, %d' TO B(C).", "p_partkey", F.format_string("%d.5", "p_size"), "p_size")
    text = F.regexp_replace(text, "B\\(C\\)", "(B)")
    found = cobol.tokens(members(p, bucket(F.col("p_partkey"), 200, "P"), F.col("p_partkey"), text).withColumn("format", F.lit("fixed")))
    return found.withColumn("kind", F.col("kind")).filter("NOT (kind = 'word' AND up = 'IF')").groupBy("kind").agg(F.count("*").alias("tokens"))


def order_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paragraph per order; what it does depends on the order's status and priority."""
    o = table(spark, sf_dir, "orders")
    deep = F.pmod("o_custkey", F.lit(4)).cast("int")
    nest = F.concat(F.repeat(F.lit("           IF A = 1\n"), deep), F.lit("           CONTINUE\n"), F.repeat(F.lit("           END-IF\n"), deep), F.lit("           ."))
    action = (
        F.when(F.col("o_orderstatus") == "F", F.lit("           ADD 1 TO T ON SIZE ERROR DISPLAY 'BIG' END-ADD."))
        .when(F.col("o_orderstatus") == "O", F.lit("           READ INFILE AT END MOVE 1 TO EOF NOT AT END\n              DISPLAY 'GOT' END-READ."))
        .otherwise(F.lit("           EVALUATE X WHEN 1 WHEN 2 STOP RUN\n              WHEN OTHER GOBACK END-EVALUATE."))
    )
    text = F.concat(area_a("P-%d.\n", "o_orderkey"), action, F.lit("\n"), nest)
    return members(o, bucket(F.col("o_orderkey"), 1000, "ORD"), F.col("o_orderkey"), text, head=ID + PROC).withColumn("format", F.lit("fixed"))


@REGISTRY.query("cobol_paragraph_headers", "SELECT concat('P-', o_orderkey) AS name, floor(o_orderkey / 1000)::BIGINT AS program FROM orders")
def paragraph_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cobol.paragraphs(cobol.parsed(order_programs(spark, sf_dir)), ["member", "name"])
    return found.select("name", F.substring("member", 4, 20).cast("long").alias("program"))


@REGISTRY.query(
    "cobol_statements_by_kind",
    """WITH o AS (SELECT o_orderstatus AS s, o_custkey % 4 AS d FROM orders)
SELECT node, sum(n)::BIGINT AS statements FROM (
  SELECT 'ContinueStmt' AS node, count(*) AS n FROM o UNION ALL SELECT 'IfStmt', sum(d) FROM o
  UNION ALL SELECT unnest(['HandledStmt', 'Action', 'Action']), count(*) FROM o WHERE s = 'F' GROUP BY 1
  UNION ALL SELECT 'IoStmt', count(*) FROM o WHERE s = 'O' UNION ALL SELECT 'Action', 2 * count(*) FROM o WHERE s = 'O'
  UNION ALL SELECT 'EvaluateStmt', count(*) FROM o WHERE s NOT IN ('F', 'O') UNION ALL SELECT 'TerminateStmt', 3 * count(*) FROM o WHERE s NOT IN ('F', 'O'))
GROUP BY node HAVING sum(n) > 0""",
)
def statements_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cobol.statements(cobol.parsed(order_programs(spark, sf_dir)), ["node"])
    return found.groupBy("node").agg(F.count("*").alias("statements"))


@REGISTRY.query("cobol_nested_if_depth", "SELECT concat('P-', o_orderkey) AS paragraph, (o_custkey % 4)::BIGINT AS depth FROM orders WHERE o_custkey % 4 > 0")
def nested_if_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cobol.statements(cobol.parsed(order_programs(spark, sf_dir)), ["paragraph", "path", "node"]).filter("node = 'IfStmt'")
    depth = F.size(F.split("path", "\\.then\\."))
    return found.groupBy("paragraph").agg(F.max(depth).cast("long").alias("depth"))


@REGISTRY.query("cobol_end_handlers", "SELECT branch, count(*)::BIGINT AS n FROM orders, (VALUES ('AT_END'), ('NOT_AT_END')) AS b(branch) WHERE o_orderstatus = 'O' GROUP BY 1")
def end_handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cobol.statements(cobol.parsed(order_programs(spark, sf_dir)), ["branch"]).filter("branch LIKE '%AT_END'")
    return found.groupBy("branch").agg(F.count("*").alias("n"))


@REGISTRY.query(
    "cobol_data_items_typed",
    """SELECT concat('W-', p_partkey) AS name, (1 + p_partkey % 9 + p_partkey % 3)::INTEGER AS digits, (p_partkey % 3)::INTEGER AS scale, p_partkey % 2 = 0 AS signed,
  CASE p_partkey % 2 WHEN 0 THEN 'COMP-3' ELSE 'DISPLAY' END AS usage, (1 + p_size)::INTEGER AS occurs,
  concat('decimal(', 1 + p_partkey % 9 + p_partkey % 3, ',', p_partkey % 3, ')') AS spark_type FROM part""",
)
def data_items_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    places = F.pmod("p_partkey", F.lit(3)).cast("int")
    even = F.pmod("p_partkey", F.lit(2)) == 0
    pic = F.concat(F.when(even, "S").otherwise(""), F.format_string("9(%d)", (F.pmod("p_partkey", F.lit(9)) + 1).cast("int")), F.when(places > 0, F.concat(F.lit("V"), F.repeat(F.lit("9"), places))).otherwise(""))
    text = F.concat(card("05 W-%d PIC ", "p_partkey"), pic, F.when(even, " COMP-3").otherwise(""), F.format_string("\n              OCCURS %d TIMES.", (F.col("p_size") + 1).cast("int")))
    programs = cobol.parsed(members(p, bucket(F.col("p_partkey"), 200, "P"), F.col("p_partkey"), text, head=DATA + "       01 W-ALL.\n").withColumn("format", F.lit("fixed")))
    usage = F.coalesce("usage", F.lit("DISPLAY"))
    return cobol.data_items(programs).filter("parent = 'W-ALL'").select("name", "digits", "scale", "signed", usage.alias("usage"), "occurs", "spark_type")


@REGISTRY.query(
    "cobol_host_structure_expand",
    """WITH s AS (SELECT n_nationkey, unnest(['KEY', 'NAME', 'NOTE']) AS part, unnest([0, 1, 2])::INTEGER AS ord FROM nation)
SELECT concat('H-', n_nationkey) AS grp, ord, concat('H-', n_nationkey, '-', part) AS item FROM s""",
)
def host_structure_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    text = F.format_string(
        "       01 H-%1$d.\n          05 H-%1$d-KEY PIC S9(9) COMP.\n          05 FILLER PIC X.\n          05 H-%1$d-NAME PIC X(25).\n             88 H-%1$d-OK VALUE 'A' 'B' THRU 'D'.\n"
        "          05 H-%1$d-AGAIN REDEFINES H-%1$d-NAME.\n             10 H-%1$d-X PIC X.\n          05 H-%1$d-NOTE.\n             49 H-%1$d-L PIC S9(4) COMP.\n             49 H-%1$d-T PIC X(80).",
        "n_nationkey",
    )
    programs = cobol.parsed(members(n, bucket(F.col("n_nationkey"), 10, "N"), F.col("n_nationkey"), text, head=DATA).withColumn("format", F.lit("fixed")))
    found = cobol.host_structures(programs).filter("group RLIKE '^H-[0-9]+$'")
    return found.select(F.col("group").alias("grp"), "ord", "item")


@REGISTRY.query(
    "cobol_select_into_columns",
    """SELECT concat('H', c_custkey) AS host_var, 'C_NAME' AS col, false AS derived, NULL::VARCHAR AS expression, '' AS derived_from FROM customer
UNION ALL SELECT concat('K', c_custkey), NULL, true, 'MAX', 'C_ACCTBAL,C_BONUS' FROM customer""",
)
def select_into_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    text = card(
        "EXEC SQL SELECT A.C_NAME AS N, MAX(A.C_ACCTBAL + C_BONUS)\n             INTO :H%1$d:I1,\n             :K%1$d INDICATOR :I2 -- the targets, :NOT\n             FROM OWNER.CUSTOMER A WHERE C_ID = :ID%1$d\n             END-EXEC.",
        "c_custkey",
    )
    programs = cobol.parsed(members(c, bucket(F.col("c_custkey"), 100, "C"), F.col("c_custkey"), text, head=ID + PROC).withColumn("format", F.lit("fixed")))
    return cobol.exec_columns(programs).select("host_var", F.col("column").alias("col"), "derived", "expression", F.array_join("derived_from", ",").alias("derived_from"))


@REGISTRY.query(
    "cobol_sql_tables",
    """SELECT t AS tbl, count(*)::BIGINT AS n FROM (
  SELECT unnest([concat('T', n_nationkey), concat('R', n_regionkey), 'LOOKUP', concat('U', n_nationkey)]) AS t FROM nation) GROUP BY 1""",
)
def sql_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    text = card(
        "EXEC SQL WITH C AS (SELECT 1 FROM OWN.T%1$d)\n             SELECT X INTO :X FROM C, (R%2$d R\n             LEFT JOIN LOOKUP L ON R.A = L.A)\n             WHERE B IN (SELECT B FROM U%1$d)\n             AND D = 'FROM NOWHERE' END-EXEC.",
        "n_nationkey", "n_regionkey",
    )
    programs = cobol.parsed(members(n, bucket(F.col("n_nationkey"), 5, "N"), F.col("n_nationkey"), text, head=ID + PROC).withColumn("format", F.lit("fixed")))
    return cobol.sql_tables(programs).groupBy(F.col("table").alias("tbl")).agg(F.count("*").alias("n"))


@REGISTRY.query(
    "cobol_call_resolution",
    """SELECT concat('WS-', s_suppkey) AS name,
  CASE s_suppkey % 8 WHEN 0 THEN 'confident' WHEN 1 THEN 'candidates' WHEN 2 THEN 'mixed' WHEN 3 THEN 'variable-only' WHEN 4 THEN 'declared-88' WHEN 5 THEN 'rejected' WHEN 6 THEN 'undeclared' ELSE 'unassigned' END AS verdict,
  CASE WHEN s_suppkey % 8 = 0 THEN concat('PGM', s_suppkey) END AS resolved,
  CASE s_suppkey % 8 WHEN 0 THEN concat('PGM', s_suppkey) WHEN 1 THEN concat('PGA', s_suppkey, ',', 'PGB', s_suppkey) WHEN 2 THEN concat('PGM', s_suppkey) WHEN 4 THEN concat('PGM', s_suppkey) ELSE '' END AS candidates
FROM supplier""",
)
def call_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One program per supplier, whose call by a data item is of one of the eight kinds; lines and pictures have room for a key of 19 digits."""
    s = table(spark, sf_dir, "supplier")
    data = [
        "       01 WS-%1$d PIC X(30)\n           VALUE 'PGM%1$d'.", "       01 WS-%1$d PIC X(30).", "       01 WS-%1$d PIC X(30)\n           VALUE 'PGM%1$d'.", "       01 WS-%1$d PIC X(8).",
        "       01 WS-%1$d PIC X(30).\n          88 WS-OK VALUE 'PGM%1$d'.", "       01 WS-%1$d PIC X(8) VALUE 'A B'.", "       01 OTHER PIC X.", "       01 WS-%1$d PIC X(8).",
    ]
    code = [
        "", "           MOVE 'PGA%1$d' TO VIA.\n           MOVE VIA TO WS-%1$d.\n           MOVE 'PGB%1$d' TO WS-%1$d.", "           MOVE UNKNOWN-ITEM TO WS-%1$d.", "           MOVE UNKNOWN-ITEM TO WS-%1$d.", "",
        "           MOVE 'TOO-LONG-NAME' TO WS-%1$d.", "", "",
    ]
    shape = [d + "\n" + PROC + "       P1.\n" + c + "\n           CALL WS-%1$d USING X." for d, c in zip(data, code, strict=True)]
    text = F.lit(None).cast("string")
    for i, x in enumerate(shape):
        text = F.when(F.pmod("s_suppkey", F.lit(8)) == i, F.format_string(x, "s_suppkey")).otherwise(text)
    programs = cobol.parsed(s.select(F.format_string("S%d", "s_suppkey").alias("member"), F.concat(F.lit(DATA), text).alias("text"), F.lit("fixed").alias("format")))
    found = cobol.resolve_calls(cobol.dynamic_calls(programs), cobol.assignments(programs))
    return found.select("name", "verdict", "resolved", F.array_join("candidates", ",").alias("candidates"))


def nation_copybooks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Programs that copy their nation's copybook; each copies the one of half its number, number 1 copies number 24 again."""
    n = table(spark, sf_dir, "nation")
    programs = n.select(F.format_string("P%d", "n_nationkey").alias("member"), F.concat(F.lit(DATA), F.format_string("       COPY C%d.\n", "n_nationkey")).alias("text"))
    inner = F.when(F.col("n_nationkey") == 1, "       COPY C24.\n").when(F.col("n_nationkey") > 1, F.format_string("       COPY C%d.\n", F.floor(F.col("n_nationkey") / 2))).otherwise("       COPY GONE.\n")
    library = n.select(F.format_string("C%d", "n_nationkey").alias("member"), F.concat(F.format_string("       01 I-%d PIC X.\n", "n_nationkey"), inner).alias("text"), F.lit("lib").alias("source"))
    return programs, library


@REGISTRY.query(
    "cobol_copy_closure",
    """WITH RECURSIVE e AS (
  SELECT concat('C', n_nationkey) AS a, CASE WHEN n_nationkey = 1 THEN 'C24' WHEN n_nationkey > 1 THEN concat('C', n_nationkey // 2) ELSE 'GONE' END AS b FROM nation),
r AS (SELECT concat('P', n_nationkey) AS member, concat('C', n_nationkey) AS copy_member FROM nation
  UNION SELECT r.member, e.b FROM r JOIN e ON r.copy_member = e.a)
SELECT member, copy_member, CASE WHEN copy_member = 'GONE' THEN 'missing' ELSE 'expanded' END AS status FROM r""",
)
def copy_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    programs, library = nation_copybooks(spark, sf_dir)
    return cobol.copy_closure(programs, library).select("member", "copy_member", "status")


@REGISTRY.query(
    "cobol_copy_status",
    """WITH RECURSIVE e AS (SELECT n_nationkey::INTEGER AS a, CASE WHEN n_nationkey = 1 THEN 24 WHEN n_nationkey > 1 THEN n_nationkey // 2 ELSE -1 END::INTEGER AS b FROM nation),
r AS (SELECT n_nationkey::INTEGER AS root, n_nationkey::INTEGER AS c, NULL::INTEGER AS parent, [n_nationkey::INTEGER] AS above, false AS again FROM nation
  UNION ALL SELECT r.root, e.b, r.c, list_append(r.above, e.b), list_contains(r.above, e.b) FROM r JOIN e ON r.c = e.a WHERE NOT r.again)
SELECT concat('P', root) AS member, CASE WHEN c = -1 THEN 'GONE' ELSE concat('C', c) END AS copy_member, CASE WHEN c = -1 THEN 'missing' WHEN again THEN 'skipped-cyclic' ELSE 'expanded' END AS status,
  CASE WHEN parent IS NOT NULL THEN concat('C', parent) END AS parent FROM r""",
)
def copy_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    programs, library = nation_copybooks(spark, sf_dir)
    return cobol.copybooks(cobol.parsed(programs, library)).select("member", "copy_member", "status", "parent")


@REGISTRY.query("cobol_copy_replacing", "SELECT concat('X', p_partkey, '-NAME') AS name, 'X' || p_partkey AS parent, (1 + p_size)::INTEGER AS length FROM part")
def copy_replacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One copybook, renamed and resized by each COPY; the literal in it stays."""
    p = table(spark, sf_dir, "part")
    text = card("COPY BOOK REPLACING ==:TAG:== BY ==X%d== ==X(1)==\n              BY ==X(%d)==.", "p_partkey", F.col("p_size") + 1)
    library = spark.createDataFrame([("BOOK", "       01 :TAG:.\n          05 :TAG:-NAME PIC X(1) VALUE ':TAG:'.\n", "lib")], "member string, text string, source string")
    programs = cobol.parsed(members(p, bucket(F.col("p_partkey"), 100, "P"), F.col("p_partkey"), text, head=DATA).withColumn("format", F.lit("fixed")), library)
    found = cobol.data_items(programs).filter("level = 5 AND value = \"':TAG:'\"")
    return found.select("name", "parent", F.regexp_extract("pic", "\\((\\d+)\\)", 1).cast("int").alias("length"))


@REGISTRY.query(
    "cobol_bundle_status",
    "SELECT CASE n_nationkey % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'stale' WHEN 2 THEN 'newer' ELSE 'foreign' END AS status, count(*)::BIGINT AS n FROM nation GROUP BY 1",
)
def bundle_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    text = F.concat(F.lit(ID + PROC), F.format_string("       P1.\n           DISPLAY '%s'.\n", "n_name"))
    programs = cobol.parsed(n.select(F.col("n_nationkey").cast("string").alias("member"), text.alias("text")))
    made = cobol.bundles(programs).join(programs.select("member", "text"), "member")
    kind = F.pmod(F.col("member").cast("int"), F.lit(4))
    bundle = F.when(kind == 2, F.replace("bundle", F.lit('"version": 12'), F.lit('"version": 13'))).when(kind == 3, F.replace("bundle", F.lit('"format": "cobol-parser"'), F.lit('"format": "other"'))).otherwise(F.col("bundle"))
    source = F.when(kind == 1, F.concat("text", F.lit("changed"))).otherwise(F.col("text"))
    return made.select(cobol.checked_bundle(bundle, source).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@REGISTRY.query(
    "cobol_needs",
    """SELECT kind, count(*)::BIGINT AS n FROM supplier, (VALUES ('program'), ('file'), ('db2-table'), ('copybook')) AS k(kind) GROUP BY 1""",
)
def needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    text = F.format_string(
        ID + "       ENVIRONMENT DIVISION.\n       INPUT-OUTPUT SECTION.\n       FILE-CONTROL.\n           SELECT F1 ASSIGN TO DD%1$d STATUS FS.\n       DATA DIVISION.\n       COPY B%1$d.\n"
        + PROC + "       P1.\n           CALL 'S%1$d'. CALL 'S%1$d'.\n           EXEC SQL DELETE FROM O.T%1$d WHERE A = :B END-EXEC.\n", "s_suppkey",
    )
    programs = cobol.parsed(s.select(F.format_string("P%d", "s_suppkey").alias("member"), text.alias("text")))
    return cobol.needs(programs).groupBy("kind").agg(F.count("*").alias("n"))
