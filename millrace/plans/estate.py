"""Queries over retrieval, lookups and comparisons, on rows of the driver's tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.cobol_text import mask_literals
from millrace.functions.shipping import ship
from millrace.operators import estate
from millrace.plans.render import table
from millrace.registry import Registry
from millrace.sources.members import canonical_type, looks_like_jcl, member_key

REGISTRY = Registry()


def picked(key: str, values: list[str | None]):
    """The value at ``key`` modulo their number."""
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), F.pmod(F.col(key), F.lit(len(values))).cast("int"))


@REGISTRY.query(
    "estate_kind_reduction",
    """SELECT event_type, CASE event_id % 4 WHEN 0 THEN 'terminal-map' WHEN 1 THEN 'db2-table' WHEN 2 THEN 'cics-urimap' END AS kind, count(*)::BIGINT AS n FROM events GROUP BY 1, 2""",
)
def kind_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_type", estate.manifest_kind(picked("event_id", [" mapset ", "Table", "CICS-URIMAP", "gadget"])).alias("kind")).groupBy("event_type", "kind").agg(F.count("*").alias("n"))


@REGISTRY.query("member_keys", "SELECT n_name AS member, count(*)::BIGINT AS n FROM nation GROUP BY 1")
def member_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(member_key(F.concat(F.lit(" '"), F.lower("n_name"), F.lit("' "))).alias("k"), "n_name").select(F.when(F.col("k") == F.upper("n_name"), F.col("n_name")).otherwise("?").alias("member")).groupBy("member").agg(F.count("*").alias("n"))


@REGISTRY.query("canonical_types", "SELECT CASE r_regionkey % 5 WHEN 0 THEN 'asm' WHEN 1 THEN 'cobol' WHEN 2 THEN 'pli' WHEN 3 THEN 'jcl' END AS kind, r_name FROM region")
def canonical_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(canonical_type(picked("r_regionkey", [" HLASM", "Cbl", "PL/I", "JCL ", None])).alias("kind"), "r_name")


@REGISTRY.query("jcl_detection", "SELECT n_nationkey % 4 < 2 AS jcl, count(*)::BIGINT AS n FROM nation GROUP BY 1")
def jcl_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    name = picked("n_nationkey", ["A.PRC", "A", "A", "A.cbl"])
    text = picked("n_nationkey", ["x", "//* remark\n\n//J1  job (A)\n", "//S1 EXEC PGM=X\n//J JOB", "       IDENTIFICATION DIVISION."])
    return n.select(looks_like_jcl(name, text).alias("jcl")).groupBy("jcl").agg(F.count("*").alias("n"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest row per line item, of eight kinds."""
    rows = table(spark, sf_dir, "lineitem")
    k = F.pmod("l_partkey", F.lit(8))
    artifact = F.when(k == 0, F.format_string("LIB.X(M%d)", F.pmod("l_partkey", F.lit(500)))).when(k == 1, "NOT A NAME").otherwise(F.format_string("M%d", F.pmod("l_partkey", F.lit(500))))
    return rows.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), artifact.alias("artifact"),
        picked("l_partkey", ["copybook", "copybook", "program", "file", "file", "caller", "program", "gadget"]).alias("kind"), F.lit("runtime").alias("dependency"),
        picked("l_partkey", [None, None, None, None, None, None, "ibm-runtime", None]).alias("classification"), F.lit(False).alias("dynamic"),
        picked("l_partkey", [None, None, None, "DS.A", None, None, None, None]).alias("dataset"), F.lit(None).cast("string").alias("ddname"),
    )


@REGISTRY.query(
    "estate_fetch_plan",
    """SELECT CASE l_partkey % 8 WHEN 1 THEN 'not-a-member-name' WHEN 4 THEN 'unbound-file' WHEN 5 THEN 'never-fetchable' WHEN 6 THEN 'not-fetchable' WHEN 7 THEN 'unknown-kind' END AS reason,
  CASE l_partkey % 8 WHEN 0 THEN 'copybook' WHEN 2 THEN 'cobol,asm' WHEN 3 THEN 'cntl' END AS types, CASE l_partkey % 8 WHEN 0 THEN 'member' WHEN 3 THEN 'dataset' END AS requested_as, count(*)::BIGINT AS n
FROM lineitem GROUP BY 1, 2, 3""",
)
def fetch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = estate.fetch_plan(manifest(spark, sf_dir))
    return found.groupBy("reason", F.array_join("types", ",").alias("types"), "requested_as").agg(F.count("*").alias("n"))


@REGISTRY.query(
    "estate_fetch_status",
    """WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS seq, l_partkey % 8 AS k, l_partkey % 500 AS m FROM lineitem),
r AS (SELECT *, CASE WHEN k = 0 THEN concat('c', m) WHEN k = 2 THEN concat('p', m) WHEN k = 3 THEN 'ds' END AS asked FROM l),
o AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY seq) AS nth,
  CASE WHEN asked IS NULL THEN 'skipped' WHEN k = 3 THEN 'not-found' WHEN k = 0 AND m % 3 = 0 THEN 'prefetched' WHEN k = 0 THEN CASE WHEN m % 7 = 0 THEN 'error' ELSE 'not-found' END
    WHEN m = 10 THEN 'subject' ELSE CASE WHEN m % 5 = 0 THEN 'fetched' ELSE 'not-found' END END AS first FROM r)
SELECT CASE WHEN asked IS NOT NULL AND nth > 1 AND first IN ('fetched', 'prefetched') THEN 'already-fetched' ELSE first END AS status,
  CASE WHEN nth = 1 AND first = 'fetched' THEN 'asm' END AS language, count(*)::BIGINT AS n FROM o GROUP BY 1, 2""",
)
def fetch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = spark.range(500).select(F.format_string("M%d", "id").alias("name"), "id")
    none = F.lit(None).cast("string")
    store = members.filter("id % 3 = 0").select(F.col("name").alias("member"), F.lit("copybook").alias("asked_type"), F.col("id").alias("ord"), F.lit("x").alias("text"), F.lit("lib").alias("source"))
    books = members.filter("id % 7 = 0").select("name", F.lit("copybook").alias("asked_type"), F.lit("error").alias("outcome"))
    programs = members.filter("id % 5 = 0").select("name", F.lit("asm").alias("asked_type"), F.lit("found").alias("outcome"))
    answers = books.unionByName(programs).select(F.lit(1).alias("seq"), "name", "asked_type", "outcome", F.lit("S").alias("source"), none.alias("detected_type"))
    found = estate.fetched(estate.fetch_plan(manifest(spark, sf_dir)), "m10", store, answers)
    return found.groupBy("status", "language").agg(F.count("*").alias("n"))


@REGISTRY.query("estate_no_service", "SELECT CASE WHEN l_partkey % 8 IN (0, 2, 3) THEN 'no-service' ELSE 'skipped' END AS status, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def no_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = spark.createDataFrame([], "member string, asked_type string, ord long, text string, source string")
    return estate.status_counts(estate.fetched(estate.fetch_plan(manifest(spark, sf_dir)), "?", empty, None))


@REGISTRY.query(
    "estate_candidate_requests",
    """SELECT concat('A', s_suppkey) AS request, 'assigned' AS evidence FROM supplier UNION ALL SELECT concat('D', s_suppkey), 'declared-88' FROM supplier WHERE s_suppkey % 2 = 0""",
)
def candidate_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    calls = s.select(
        F.col("s_suppkey").alias("seq"), F.lit("WS").alias("item"), F.array(F.format_string("'a%d'", "s_suppkey"), F.lit("no name!")).alias("candidates"),
        F.when(F.col("s_suppkey") % 2 == 0, F.array(F.format_string(" D%d", "s_suppkey"))).alias("declared_candidates"),
    )
    return estate.candidate_plan(calls).select("request", "evidence")


@REGISTRY.query(
    "estate_prefetch_status",
    """WITH p AS (SELECT p_partkey, p_partkey % 6 AS k, p_partkey % 100 AS m FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN k = 5 THEN 'bad name' ELSE concat('M', m) END ORDER BY p_partkey) AS nth FROM p)
SELECT CASE WHEN nth > 1 OR (k <> 5 AND m % 10 = 9) THEN 'seen' WHEN k = 5 THEN 'skipped' WHEN m % 4 = 0 THEN 'local' WHEN m % 4 = 1 THEN 'fetched' WHEN m % 4 = 2 THEN 'error' ELSE 'not-found' END AS status,
  count(*)::BIGINT AS n FROM n GROUP BY 1""",
)
def prefetch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 6 == 5, "bad name").otherwise(F.format_string("m%d", F.pmod("p_partkey", F.lit(100))))
    asks = p.select(F.col("p_partkey").alias("seq"), name.alias("name"), F.lit("copybook").alias("asked_type"))
    m = spark.range(100).select("id", F.format_string("M%d", "id").alias("member"))
    local = m.filter("id % 4 = 0").select("member", F.lit(1).alias("rank"), F.lit("here").alias("source"))
    outcome = F.when(F.col("id") % 4 == 1, "found").when(F.col("id") % 4 == 2, "error")
    answers = m.filter("id % 4 IN (1, 2)").select(F.col("id").alias("seq"), F.col("member").alias("name"), F.lit("copybook").alias("asked_type"), outcome.alias("outcome"), F.lit("lib").alias("source"))
    return estate.status_counts(estate.prefetched(asks, local, m.filter("id % 10 = 9").select("member"), answers))


@REGISTRY.query(
    "estate_replay_first_answer",
    """WITH a AS (SELECT user_id, arg_min(event_type, event_id) AS outcome FROM events WHERE user_id % 2 = 0 GROUP BY 1)
SELECT e.event_id, coalesce(a.outcome, 'no-record') AS outcome FROM events e LEFT JOIN a ON e.user_id = a.user_id""",
)
def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    named = e.select(F.col("event_id").alias("seq"), F.format_string("u%d", "user_id").alias("name"), F.lit(None).cast("string").alias("asked_type"), F.col("event_type").alias("outcome"), F.lit("t").alias("text"), F.lit("s").alias("source"), "user_id")
    found = estate.replayed(named.select("seq", "name", "asked_type"), named.filter("user_id % 2 = 0"))
    return found.select(F.col("seq").alias("event_id"), "outcome")


@REGISTRY.query(
    "estate_synonyms",
    """SELECT upper(n_name) AS name, CASE WHEN n_regionkey < 2 THEN concat('R', n_regionkey) WHEN n_nationkey % 2 = 0 THEN concat('N', n_nationkey) END AS base,
  CASE WHEN n_regionkey < 2 THEN 'map' WHEN n_nationkey % 2 = 0 THEN 'resolver' END AS door FROM nation""",
)
def synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    mapping = n.filter("n_regionkey < 2").select(F.col("n_name").alias("name"), F.format_string("r%d", "n_regionkey").alias("base"))
    resolver = n.filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"), F.format_string(" n%d ", "n_nationkey").alias("base"))
    return estate.synonyms(n.select(F.lower("n_name").alias("name")), mapping, resolver)


@REGISTRY.query(
    "estate_dependents",
    """SELECT concat('N', n_nationkey) AS name, CASE WHEN n_nationkey % 5 = 4 THEN 'not-answered' WHEN n_nationkey % 5 = 3 AND count(s_suppkey) > 0 THEN 'broken' ELSE 'answered' END AS answer_status,
  CASE WHEN n_nationkey % 5 = 4 OR (n_nationkey % 5 = 3 AND count(s_suppkey) > 0) THEN NULL ELSE count(s_suppkey) END::INTEGER AS n_rows
FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND n_nationkey % 5 <> 2 GROUP BY n_nationkey""",
)
def dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    name = F.format_string("N%d", "n_nationkey")
    coverage = n.filter("n_nationkey % 5 <> 4").select(name.alias("name"), F.lit("PROGRAM").alias("kind"))
    edges = s.filter("s_nationkey % 5 NOT IN (2, 4)").select(
        F.format_string("n%d", "s_nationkey").alias("of_name"), F.lit("MODULE").alias("of_kind"), F.format_string("S%d", "s_suppkey").alias("name"),
        F.when(F.col("s_nationkey") % 5 == 3, "gadget").otherwise("JOB").alias("kind"), F.lit("CALL").alias("via"), F.lit("bare").alias("match_strength"), F.lit(None).cast("string").alias("detail"),
    )
    asks = n.select(F.col("n_nationkey").alias("seq"), name.alias("name"), F.when(F.col("n_nationkey") % 2 == 0, "program").alias("kind"))
    return estate.dependents(asks, coverage, edges).select("name", "answer_status", F.when(F.col("rows").isNotNull(), F.size("rows")).alias("n_rows"))


@REGISTRY.query(
    "estate_manifest_complaints",
    """SELECT complaint, count(*)::BIGINT AS n FROM (
  SELECT unnest(list_filter([CASE WHEN p_partkey % 5 = 0 THEN 'no kind' END, CASE WHEN p_partkey % 7 = 0 THEN 'dependency=maybe' END, CASE WHEN p_partkey % 3 = 0 THEN 'io=scan' END,
    CASE WHEN p_partkey % 11 = 0 THEN 'empty needs' END], lambda x: x IS NOT NULL)) AS complaint FROM part) GROUP BY 1""",
)
def manifest_complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    on = lambda k, yes, no: F.when(F.col("p_partkey") % k == 0, F.lit(yes).cast("string")).otherwise(F.lit(no).cast("string"))
    rows = p.select(
        F.col("p_partkey").alias("seq"), F.col("p_name").alias("artifact"), on(5, None, "program").alias("kind"), on(7, "maybe", "runtime").alias("dependency"),
        F.lit("global").alias("identity"), on(3, "scan", "read").alias("io"), on(11, "", "x").alias("needs"), F.lit(None).cast("string").alias("resolved_by"),
    )
    return estate.complaints(rows).groupBy("complaint").agg(F.count("*").alias("n"))


@REGISTRY.query(
    "estate_store_lookup",
    """SELECT s_suppkey AS seq, CASE s_suppkey % 4 WHEN 0 THEN 'typed' WHEN 1 THEN 'untyped' WHEN 2 THEN 'member' END AS source FROM supplier""",
)
def store_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey") % 4
    name = F.when(k == 2, F.format_string("LIB.A(S%d)", "s_suppkey")).otherwise(F.format_string("s%d", "s_suppkey"))
    asks = s.select(F.col("s_suppkey").alias("seq"), name.alias("name"), F.when(k == 2, F.lit(None).cast("string")).otherwise("proc").alias("asked_type"))
    row = lambda kind, source, ord_: F.struct(F.lit(kind).cast("string").alias("asked_type"), F.lit(source).alias("source"), F.lit(ord_).alias("ord"))
    entries = F.when(k == 0, F.array(row(None, "untyped", 0), row("proc", "typed", 1))).when(k == 1, F.array(row(None, "untyped", 1), row("cntl", "other", 0))).when(k == 2, F.array(row("cntl", "later", 2), row("proc", "member", 1))).otherwise(F.array(row("cntl", "other", 0)))
    store = s.select(F.format_string("S%d", "s_suppkey").alias("member"), F.explode(entries).alias("e")).select("member", "e.*", F.lit("text").alias("text"))
    return estate.stored(asks, store).select("seq", F.col("hit.source").alias("source"))


@REGISTRY.query(
    "digest_ratchet",
    """WITH a AS (SELECT o_orderkey AS key, sha256(o_orderstatus) AS d FROM orders WHERE o_custkey % 3 <> 0),
b AS (SELECT o_orderkey AS key, sha256(CASE WHEN o_custkey % 5 = 0 THEN 'new' ELSE o_orderstatus END) AS d FROM orders WHERE o_custkey % 4 <> 0)
SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.d IS NULL THEN 'MISSING' WHEN a.d IS NULL THEN 'ADDED' ELSE 'CHANGED' END AS change
FROM a FULL JOIN b ON a.key = b.key WHERE a.d IS NULL OR b.d IS NULL OR a.d <> b.d""",
)
def digest_ratchet(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "key")
    digest = lambda text: F.sha2(text.cast("binary"), 256).alias("digest")
    before = o.filter("o_custkey % 3 <> 0").select("key", digest(F.col("o_orderstatus")))
    after = o.filter("o_custkey % 4 <> 0").select("key", digest(F.when(F.col("o_custkey") % 5 == 0, "new").otherwise(F.col("o_orderstatus"))))
    return estate.ratchet(before, after)


@REGISTRY.query(
    "producer_diff",
    """WITH l AS (SELECT o_orderkey % 100 AS line, o_custkey % 6 AS k FROM orders)
SELECT CASE WHEN k = 0 THEN 'missed-by-native' WHEN k = 1 THEN 'missed-by-external' WHEN k = 2 THEN 'agree-opaque' ELSE 'agree-typed' END AS outcome, line >= 30 AND line < 45 AS in_error_paragraph, count(*)::BIGINT AS n
FROM l GROUP BY 1, 2""",
)
def producer_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 100).alias("member"), (F.col("o_orderkey") % 100).alias("line"), (F.col("o_custkey") % 6).alias("k"))
    native = rows.filter("k <> 0").select("member", "line", F.when(F.col("k") == 2, "?").otherwise("MOVE").alias("verb"))
    paragraphs = rows.select("member").distinct().select("member", F.lit(30).alias("from_line"), F.lit(45).alias("to_line"))
    found = estate.producer_diff(native, rows.filter("k <> 1").select("member", "line"), paragraphs)
    return found.groupBy("outcome", "in_error_paragraph").agg(F.count("*").alias("n"))


@REGISTRY.query("first_and_last_wins", "SELECT user_id, arg_min(event_type, event_id) AS first, arg_max(event_type, event_id) AS last FROM events GROUP BY 1")
def first_and_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    first = estate.first_by(e, ["user_id"], "event_id", "event_type").withColumnRenamed("event_type", "first")
    return first.join(estate.last_by(e, ["user_id"], "event_id", "event_type").withColumnRenamed("event_type", "last"), "user_id")


@REGISTRY.query(
    "mask_literals",
    r"""SELECT doc_id, length(coalesce(text, ''))::INTEGER AS length, (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '''[^'']*''|"[^"]*"', '', 'g')))::INTEGER AS masked FROM documents""",
)
def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return texts.map(mask_literals)

    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace(F.coalesce("text", F.lit("")), F.lit("\0"), F.lit(" ")).alias("text"))
    shown = docs.select("doc_id", mask("text").alias("shown"))
    return shown.select("doc_id", F.length("shown").alias("length"), (F.length("shown") - F.length(F.replace("shown", F.lit("\0"), F.lit("")))).alias("masked"))
