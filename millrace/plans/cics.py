"""Queries over CICS definitions rendered from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import cics
from millrace.plans.render import bucket, members, table
from millrace.registry import Registry
from millrace.sources.members import deck_lines

REGISTRY = Registry()


def supplier_deck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A FILE definition per supplier on three lines, with a comment between definitions."""
    s = table(spark, sf_dir, "supplier")
    text = F.format_string(
        "* supplier %d\nDEFINE FILE(F%d) GROUP(G%d)\n       DESCRIPTION(%s, no. (%d))\nADD(YES) KEYS(%d,%d) DISABLED",
        "s_suppkey", "s_suppkey", "s_nationkey", F.lit("a supplier"), "s_suppkey", F.pmod("s_suppkey", F.lit(7)), F.pmod("s_suppkey", F.lit(11)),
    )
    return members(s, bucket(F.col("s_suppkey"), 50, "DECK"), F.col("s_suppkey"), text)


@REGISTRY.query("csd_files_per_group", "SELECT concat('G', s_nationkey) AS grp, count(*)::BIGINT AS files FROM supplier GROUP BY 1")
def files_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cics.deck(supplier_deck(spark, sf_dir)).filter("verb = 'DEFINE'")
    return found.select(cics.first_value(F.col("operands"), "GROUP").alias("grp")).groupBy("grp").agg(F.count("*").alias("files"))


@REGISTRY.query(
    "csd_operand_values_with_commas",
    "SELECT concat('F', s_suppkey) AS file, concat(s_suppkey % 7, ',', s_suppkey % 11) AS keys, concat('a supplier, no. (', s_suppkey, ')') AS description FROM supplier",
)
def operand_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = lambda k: cics.first_value(F.col("operands"), k)
    return cics.deck(supplier_deck(spark, sf_dir)).select(value("FILE").alias("file"), value("KEYS").alias("keys"), value("DESCRIPTION").alias("description"))


@REGISTRY.query("csd_add_yes_is_operand", "SELECT 'DEFINE' AS verb, count(*)::BIGINT AS statements, count(*)::BIGINT AS added, count(*)::BIGINT AS bare FROM supplier")
def add_yes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.exists("operands", lambda x: (x["keyword"] == "DISABLED") & x["value"].isNull())
    found = cics.deck(supplier_deck(spark, sf_dir)).select("verb", cics.first_value(F.col("operands"), "ADD").alias("added"), bare.alias("bare"))
    return found.groupBy("verb").agg(F.count("*").alias("statements"), F.count_if(F.col("added") == "YES").alias("added"), F.count_if("bare").alias("bare"))


@REGISTRY.query(
    "csd_operand_lines",
    """SELECT concat('F', s_suppkey) AS file, (4 * (row_number() OVER (PARTITION BY floor(s_suppkey / 50) ORDER BY s_suppkey) - 1) + 2)::INTEGER AS line,
  (4 * (row_number() OVER (PARTITION BY floor(s_suppkey / 50) ORDER BY s_suppkey) - 1) + 4)::INTEGER AS keys_line FROM supplier""",
)
def operand_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.get(F.filter("operands", lambda x: x["keyword"] == "KEYS"), 0)["line"]
    return cics.deck(supplier_deck(spark, sf_dir)).select(cics.first_value(F.col("operands"), "FILE").alias("file"), "line", keys.alias("keys_line"))


def part_deck(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    pad = F.repeat(F.lit(" "), F.pmod("p_partkey", F.lit(13)).cast("int"))
    text = F.concat(F.format_string("DEFINE FILE(P%08d) GROUP(PARTS) DESCRIPTION(of the size)", "p_partkey"), pad, F.format_string("SIZE(%d)", "p_size"))
    return members(p, bucket(F.col("p_partkey"), 500, "PARTS"), F.col("p_partkey"), text)


@REGISTRY.query(
    "csd_margin_cut",
    """WITH t AS (SELECT length('DEFINE FILE(P00000000) GROUP(PARTS) DESCRIPTION(of the size)') + p_partkey % 13 + length(concat('SIZE(', p_size, ')')) AS n FROM part)
SELECT count(*)::BIGINT AS statements, (count(*) FILTER (WHERE n > 72))::BIGINT AS cut, (count(*) FILTER (WHERE n > 72))::BIGINT AS flagged FROM t""",
)
def margin_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    decks = cics.with_prelude(part_deck(spark, sf_dir))
    found = cics.deck(decks).agg(F.count("*").alias("statements"), F.count_if(F.exists("damaged", lambda x: x.startswith("cut at"))).alias("cut"))
    flagged = cics.deck_flags(decks).agg(F.count_if(F.col("flag") == "past-margin").alias("flagged"))
    both = found.unionByName(flagged, allowMissingColumns=True)
    return both.agg(*[F.sum(c).alias(c) for c in both.columns])


@REGISTRY.query(
    "csd_report_to_define",
    "SELECT 'DEFINE' AS verb, concat('F', c_custkey) AS file, concat('G', c_nationkey) AS grp, concat('SYS', c_custkey % 5) AS sysid FROM customer",
)
def report_to_define(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    text = F.format_string(
        " FILE(F%d) GROUP(G%d)                                  24.001 12:30\n    REMOTESYSTEM(SYS%d)\n    DEFINETIME(22/06/10 20:03:53)\n DFH5120 I PRIMARY CSD CLOSED;",
        "c_custkey", "c_nationkey", F.pmod("c_custkey", F.lit(5)),
    )
    found = cics.listing(members(c, bucket(F.col("c_custkey"), 1000, "LIST"), F.col("c_custkey"), text))
    value = lambda k: cics.first_value(F.col("operands"), k)
    return found.select("verb", value("FILE").alias("file"), value("GROUP").alias("grp"), value("REMOTESYSTEM").alias("sysid"))


@REGISTRY.query(
    "macro_continuation",
    """SELECT concat('L', o_orderkey) AS label, 'DFHFCT' AS operation, concat('T', o_custkey) AS dataset, concat('(', o_orderstatus, ',X)') AS servreq,
  'TYPE' AS positional FROM orders""",
)
def macro_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    card = lambda x: F.concat(F.rpad(x, 71, " "), F.lit("X"))
    first = card(F.format_string("L%d DFHFCT TYPE,DATASET=T%d,", "o_orderkey", "o_custkey"))
    text = F.concat(F.lit("* an order\n"), first, F.format_string("\n               SERVREQ=(%s,X)  a remark", "o_orderstatus"))
    found = cics.macros(members(o, bucket(F.col("o_orderkey"), 5000, "MAC"), F.col("o_orderkey"), text)).filter("operation IS NOT NULL")
    value = lambda k: cics.first_value(F.col("operands"), k)
    return found.select("label", "operation", value("DATASET").alias("dataset"), value("SERVREQ").alias("servreq"), F.array_join("positional", ",").alias("positional"))


@REGISTRY.query("window_equals_whole", "SELECT 0::BIGINT AS missing, 0::BIGINT AS added")
def window_equals_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of overlapping ranges of lines, lexed with the whole's prelude, against those of the whole."""
    whole = cics.with_prelude(supplier_deck(spark, sf_dir))
    shown = lambda df: df.select("member", "line", F.to_json(F.struct("verb", "operands", "damaged")).alias("s"))
    ranges = [cics.deck(whole.select("member", "prelude", F.slice("lines", a, n).alias("lines")), first_line=a) for a, n in ((1, 101), (98, 400))]
    # the last statement of a range may go on behind it, where the member does
    last = ranges[0].groupBy("member").agg(F.max("statement").alias("statement")).join(whole.filter(F.size("lines") > 101).select("member"), "member")
    parts = shown(ranges[0].join(last, ["member", "statement"], "left_anti")).unionByName(shown(ranges[1])).distinct()
    every = shown(cics.deck(whole))
    keys = ["member", "line", "s"]
    lost = every.join(parts, keys, "left_anti").agg(F.count("*").alias("missing"))
    both = lost.unionByName(parts.join(every, keys, "left_anti").agg(F.count("*").alias("added")), allowMissingColumns=True)
    return both.agg(*[F.sum(c).alias(c) for c in both.columns])


@REGISTRY.query(
    "prelude_per_source",
    r"""WITH l AS (
  SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\x0B\x0C\r\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]')) AS line FROM documents)
SELECT doc_id, max(length(line))::INTEGER AS longest, (count(DISTINCT left(line, 1)) FILTER (WHERE regexp_matches(line, '[^\s\x0B\x1C-\x1F\x{85}\x{A0}]')))::INTEGER AS first_characters
FROM l GROUP BY doc_id""",
)
def prelude_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", cics.prelude(deck_lines(F.coalesce("text", F.lit("")))).alias("p"))
    return docs.select("doc_id", "p.longest", F.size("p.column_one").alias("first_characters"))


@REGISTRY.query(
    "source_kinds",
    """SELECT CASE n_nationkey % 7 WHEN 0 THEN 'csd' WHEN 1 THEN 'csd' WHEN 2 THEN 'bms' WHEN 3 THEN 'macro-table' WHEN 4 THEN 'bas' WHEN 5 THEN 'sit' ELSE 'bundle' END AS kind,
  count(*)::BIGINT AS members FROM nation GROUP BY 1""",
)
def source_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = ["DEFINE FILE(A) GROUP(B)", " FILE(A) GROUP(B)\n   DEFINETIME(1)", "M DFHMSD TYPE=MAP", "T DFHPCT TYPE=INITIAL", "CREATE FILEDEF NAME(X)", "  DFHSIT TYPE=CSECT", "<?xml version='1.0'?>"]
    n = table(spark, sf_dir, "nation")
    text = F.concat(F.get(F.array(*[F.lit(x) for x in shapes]), F.pmod("n_nationkey", F.lit(7)).cast("int")), F.lit("\n* of "), "n_name")
    return n.select(cics.source_kind(text).alias("kind")).groupBy("kind").agg(F.count("*").alias("members"))
