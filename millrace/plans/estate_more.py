"""Queries over services that are asked, retrieval that closes, members' bytes and names, and the functions that SQL can call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import sql_functions
from millrace.operators import cobol, estate, retrieval
from millrace.plans.estate import picked
from millrace.plans.render import table
from millrace.registry import Registry
from millrace.sources.members import decoded, saved_name, type_disagreement

REGISTRY = Registry()


def answering(name: str, type: str | None = None) -> object:  # noqa: A002 - the keyword that services are called with
    """A service that answers by the number in a name."""
    n = int(name[1:])
    if n % 5 == 4:
        raise TimeoutError("down")
    return [f"text {n}", None, {"text": f"text {n}".encode(), "detected_type": "asm", "source": "lib"}, (f"text {n}", "dsn")][n % 5]


@REGISTRY.query(
    "estate_service_answers",
    """SELECT n_nationkey::BIGINT AS seq, CASE n_nationkey % 5 WHEN 1 THEN 'not-found' WHEN 4 THEN 'error' ELSE 'found' END AS outcome,
  CASE WHEN n_nationkey % 5 IN (0, 2, 3) THEN concat('text ', n_nationkey) END AS text, CASE n_nationkey % 5 WHEN 0 THEN concat('N', n_nationkey) WHEN 2 THEN 'lib' WHEN 3 THEN 'dsn' END AS source,
  CASE WHEN n_nationkey % 5 = 2 THEN 'asm' END AS detected_type, CASE WHEN n_nationkey % 5 = 4 THEN 'TimeoutError: down' END AS error FROM nation""",
)
def service_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    asks = n.select(F.col("n_nationkey").alias("seq"), F.format_string("N%d", "n_nationkey").alias("name"), F.lit("cobol").alias("asked_type"))
    return retrieval.ask_service(asks, answering).select("seq", "outcome", "text", "source", "detected_type", "error")


def books(name: str, type: str | None = None) -> str | None:  # noqa: A002
    """Copybook n copies that of half its number; those divisible by 7 are not there."""
    n = int(name[1:])
    return None if n % 7 == 0 else f"       01 I-{n} PIC X.\n       COPY C{n // 2}.\n"


@REGISTRY.query(
    "estate_closed_retrieval",
    """WITH RECURSIVE c AS (SELECT n_nationkey AS n, 0 AS level FROM nation WHERE n_nationkey >= 13
UNION ALL SELECT n // 2, level + 1 FROM c WHERE n % 7 <> 0 AND n > 0)
SELECT concat('C', n) AS member, min(level)::INTEGER AS level, CASE WHEN n % 7 = 0 THEN 'not-found' ELSE 'fetched' END AS status FROM c GROUP BY n""",
)
def closed_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = table(spark, sf_dir, "nation").filter("n_nationkey >= 13").select(F.format_string("C%d", "n_nationkey").alias("member"))
    local = spark.createDataFrame([], "member string, text string, source string")
    return retrieval.closed(start, local, cobol.copy_edges, lambda asks: retrieval.ask_service(asks, books)).select("member", "level", "status")


@REGISTRY.query(
    "estate_retrieval_report",
    """SELECT CASE s_suppkey % 3 WHEN 0 THEN 'fetched' WHEN 1 THEN 'not-found' ELSE 'error' END AS status, count(*)::BIGINT AS n,
  coalesce(string_agg(DISTINCT CASE WHEN s_suppkey % 3 > 0 THEN concat('S', s_suppkey) END, ',' ORDER BY CASE WHEN s_suppkey % 3 > 0 THEN concat('S', s_suppkey) END), '') AS missing FROM supplier GROUP BY 1""",
)
def retrieval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    rows = s.select(F.format_string("S%d", "s_suppkey").alias("member"), F.lit("cobol").alias("asked_type"), picked("s_suppkey", ["fetched", "not-found", "error"]).alias("status"))
    return retrieval.report(rows).select("status", "n", F.array_join("missing", ",").alias("missing"))


@REGISTRY.query(
    "estate_resolver_callable",
    """SELECT upper(n_name) AS name, CASE WHEN n_regionkey = 0 THEN 'MAPPED' WHEN n_nationkey % 2 = 0 THEN concat('T_', upper(n_name)) END AS base,
  CASE WHEN n_regionkey = 0 THEN 'map' WHEN n_nationkey % 2 = 0 THEN 'resolver' END AS door FROM nation""",
)
def resolver_callable(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    even = {r["name"] for r in n.filter("n_nationkey % 2 = 0").select(F.upper("n_name").alias("name")).collect()}  # 25 nations
    mapping = n.filter("n_regionkey = 0").select(F.col("n_name").alias("name"), F.lit("mapped").alias("base"))
    found = retrieval.resolved(n.select(F.lower("n_name").alias("name")), mapping, lambda name: f" t_{name} " if name in even else None, jobs=3)
    return found.select("name", "base", "door")


@REGISTRY.query(
    "estate_recorded_dependents",
    "SELECT concat('N', n_nationkey) AS name, CASE WHEN n_nationkey % 3 = 2 THEN 'not-answered' ELSE 'answered' END AS answer_status, CASE n_nationkey % 3 WHEN 0 THEN n_nationkey % 4 WHEN 1 THEN 0 END::INTEGER AS n_rows FROM nation",
)
def recorded_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a lookup answered is recorded and answers again without it."""

    def lookup(name: str, kind: str | None = None) -> list | None:
        n = int(name[1:])
        return [[{"name": f"J{i}", "kind": "JOB"} for i in range(n % 4)], [], None][n % 3]

    asks = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("seq"), F.format_string("N%d", "n_nationkey").alias("name"), F.lit("program").alias("kind"))
    back = estate.dependents(asks, *retrieval.recorded(retrieval.ask_dependents(asks, lookup)))
    return back.select("name", "answer_status", F.when(F.col("rows").isNotNull(), F.size("rows")).alias("n_rows"))


@REGISTRY.query("member_decoding", "SELECT c_custkey, concat(c_name, ' é') AS text FROM customer")
def member_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTF-8 where the bytes are that, else Latin-1."""
    text = F.concat("c_name", F.lit(" é"))
    content = F.when(F.col("c_custkey") % 2 == 0, F.encode(text, "UTF-8")).otherwise(F.encode(text, "ISO-8859-1"))
    return table(spark, sf_dir, "customer").select("c_custkey", decoded(content).alias("text"))


@REGISTRY.query(
    "member_saved_names",
    """SELECT p_partkey, concat('A_', p_partkey, CASE p_partkey % 4 WHEN 0 THEN '.cbl' WHEN 1 THEN '.asm' WHEN 2 THEN '.cpy' ELSE '.txt' END) AS name, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS differs FROM part""",
)
def saved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = picked("p_partkey", ["COBOL", "hlasm", "copybook", None])
    name = saved_name(F.format_string("A/%d", "p_partkey"), kind)
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), type_disagreement(F.lit("asm"), kind).alias("differs"))


@REGISTRY.query("sql_function_tokens", "SELECT concat('P', s_suppkey) AS member, s_suppkey::VARCHAR AS number FROM supplier")
def sql_function_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table function over the code of each supplier's member."""
    sql_functions.register(spark)
    rows = table(spark, sf_dir, "supplier").select(F.format_string("P%d", "s_suppkey").alias("member"), F.format_string("           MOVE %d TO X. *> 5", "s_suppkey").alias("text"))
    return spark.sql("SELECT m.member, t.text AS number FROM {m} AS m, LATERAL cobol_tokens(m.text, true) AS t WHERE t.kind = 'number'", m=rows)


@REGISTRY.query("sql_function_operands", "SELECT concat('F', s_suppkey) AS file, 'PROD' AS grp FROM supplier")
def sql_function_operands(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql_functions.register(spark)
    rows = table(spark, sf_dir, "supplier").select(F.format_string(" FILE(F%d) GROUP(PROD) DESCRIPTION(A, B)", "s_suppkey").alias("text"))
    return spark.sql(
        "SELECT max(CASE WHEN o.keyword = 'FILE' THEN o.value END) AS file, max(CASE WHEN o.keyword = 'GROUP' THEN o.value END) AS grp FROM {m} AS m, LATERAL csd_operands(m.text) AS o GROUP BY m.text", m=rows
    )


@REGISTRY.query(
    "sql_function_pictures",
    "SELECT p_partkey, concat('decimal(', 3 + p_partkey % 4, ',2)') AS spark_type, 'numeric' AS category, 8::INTEGER AS masked FROM part",
)
def sql_function_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql_functions.register(spark)
    rows = table(spark, sf_dir, "part").select("p_partkey", F.format_string("S9(%d)V99", (F.col("p_partkey") % 4 + 1).cast("int")).alias("pic"))
    return spark.sql("SELECT p_partkey, p.spark_type, p.category, instr(mask_literals('MOVE ''A'' TO B'), ' TO') - 1 AS masked FROM (SELECT p_partkey, parse_pic(pic, 'COMP-3') AS p FROM {r})", r=rows)


@REGISTRY.query("sql_function_tables", "SELECT concat('T', c_custkey) AS name, count(*)::BIGINT AS n FROM customer GROUP BY 1 UNION ALL SELECT 'U', count(*) FROM customer")
def sql_function_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql_functions.register(spark)
    rows = table(spark, sf_dir, "customer").select(F.format_string("DELETE FROM own.t%d WHERE x IN (SELECT y FROM u WHERE z = 'FROM v')", "c_custkey").alias("text"))
    return spark.sql("SELECT t.name, count(*) AS n FROM {r} AS r, LATERAL sql_tables(r.text) AS t GROUP BY t.name", r=rows)
