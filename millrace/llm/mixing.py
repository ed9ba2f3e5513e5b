"""Mixing sources to target weights by weighted sampling without replacement.

Sizes are word counts. Sources share ``SHARE`` of all words by weight; a
target stops at ``CAP`` times its source and the excess goes to the others.
Within a source a document's key is ``-ln(u) / q`` with a seeded uniform u and
its quality weight q (Efraimidis and Spirakis): the smallest keys are a
weighted sample without replacement. Whole epochs come first; what is left of
the target takes documents in key order while the prefix sum of sizes stays
within the budget; then the one untaken document whose size is nearest to what
is still missing, if that brings the sum closer.

Prefix sums never gather a source in one task: keys fall into ``BINS`` ranges
per source, the ranges are summed and prefix-summed, and only the one range
that holds the source's limit is ordered row by row.

Cases with a defined result: null text has size 0; a null source comes last
in the code-point order and has a weight like any other; sources without words
get target 0; ties of a key go by doc_id and size, and rows equal in all of
these (id and text too) are interchangeable; an empty table gives an empty result. Everything
here is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from millrace.llm import common

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
BINS = 4096
SEED = "mix-1"


def quality(text: Column, size: Column) -> Column:
    """Quality weight of a document: 1 for plain prose, less with symbols; 0.25 to 1."""
    chars = F.length(F.replace(common.with_spaces(text), F.lit(" "), F.lit("")))
    symbols = F.length(text) - F.length(common.without(text, "#*$%&|<>"))
    return F.when(size == 0, 0.25).when(symbols * 20 > chars, 0.25).when(symbols * 100 > chars, 0.5).otherwise(1.0)


def uniform(doc_id: Column, text: Column) -> Column:
    """Seeded uniform in (0, 1), a function of doc_id and text: rows that share an id, or have none, still spread over the keys."""
    digest = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(text.cast("binary"))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, key) of every row, plus ``d``, all columns of the row, if asked for by ``mixed``."""
    text = F.coalesce("d.text", F.lit(""))
    size = F.size(common.words(text)).cast("long")
    return docs.withColumn("size", size).withColumn("key", -F.log(uniform(F.col("d.doc_id"), text)) / quality(text, F.col("size")))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target, epochs, budget) from (source, source_size).

    One row per source; the windows over all of them, in one task, are over that
    table. So sources are labels, thousands at most, not hosts. Filling sources in the order of limit over weight is what repeated
    resharing of the excess ends in.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(x) for x in WEIGHTS]), ((F.row_number().over(order) - 1) % len(WEIGHTS)) + 1)
    df = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * CAP)
    fill = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    df = df.select(
        "source", "source_size", "weight", "limit",
        F.coalesce(F.sum("limit").over(fill), F.lit(0)).alias("c"), F.coalesce(F.sum("weight").over(fill), F.lit(0)).alias("wc"),
        (F.sum("source_size").over(whole) * SHARE).alias("total"), F.sum("weight").over(whole).alias("w"),
    )
    df = df.withColumn("fair", F.col("weight") * ((F.col("total") - F.col("c")) / (F.col("w") - F.col("wc"))))
    # the first source that stays below its limit sets the level of all after it
    level = F.min(F.when(F.col("fair") <= F.col("limit"), F.struct((F.col("limit") / F.col("weight")).alias("r"), F.col("c"), F.col("wc")))).over(whole)
    df = df.withColumn("level", level)
    df = df.withColumn("fill", F.col("weight") * ((F.col("total") - F.col("level.c")) / (F.col("w") - F.col("level.wc"))))
    df = df.withColumn("target", F.when(F.col("level").isNull() | (F.col("fair") > F.col("limit")), F.col("limit").cast("double")).otherwise(F.col("fill")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return df.select("source", "source_size", "target", epochs.alias("epochs"), (F.col("target") - epochs * F.col("source_size")).alias("budget"))


def selection(keyed: DataFrame) -> DataFrame:
    """``keyed``, a written table (source, doc_id, size, key, rid and others), with source_size, target and ``copies``.

    All that a row needs to know of its source is one small plan row: the last
    taken place in key order and the id of the one filling document. So rows
    are joined to the plans and never shuffled by source.
    """
    same = lambda a, b: F.expr(f"{a}.source <=> {b}.source")
    place = lambda: F.struct("key", F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "size", "rid")
    keyed = keyed.withColumn("bin", F.floor((1 - F.exp(-F.col("key") / 2)) * BINS).cast("int"))
    narrow = keyed.select("source", "bin", "size", "rid", "key", place().alias("place"))
    bins = common.cut(narrow.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")), "mix-bins")
    plan = targets(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")))
    bins = bins.withColumn("before", F.sum("bin_size").over(W.partitionBy("source").orderBy("bin")) - F.col("bin_size"))
    # the bin in which the prefix sum passes the budget: bins before it are taken whole, those behind it are not
    edge = (
        bins.alias("b").join(plan.alias("p"), same("b", "p"))
        .groupBy("p.source", "p.source_size", "p.target", "p.epochs", "p.budget")
        .agg(F.max(F.when(F.col("before") <= F.col("budget"), F.struct("bin", "before"))).alias("edge"))
    )
    edge = common.cut(edge.select("source", "source_size", "target", "epochs", "budget", F.col("edge.bin").alias("edge_bin"), "edge.before"), "mix-edges")
    few = edge.count() * 256
    at = common.joined(narrow.alias("k"), edge.alias("e"), same("k", "e") & F.expr("k.bin = e.edge_bin"), "inner", few)
    order = W.partitionBy("k.source").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    at = at.select("k.source", "place", "budget", "before", F.sum("size").over(order).alias("sum")).filter("before + sum <= budget")
    last = at.groupBy("source").agg(F.max("place").alias("last"), F.max("sum").alias("in_edge"))
    ends = edge.alias("e").join(last.alias("l"), same("e", "l"), "left").select("e.*", "last", (F.col("budget") - F.col("before") - F.coalesce("in_edge", F.lit(0))).alias("gap"))
    ends = common.cut(ends, "mix-ends")

    def placed(rows: DataFrame, plans: DataFrame) -> DataFrame:
        fits = (F.col("k.bin") < F.col("edge_bin")) | ((F.col("k.bin") == F.col("edge_bin")) & F.coalesce(F.col("place") <= F.col("last"), F.lit(False)))
        return common.joined(rows.alias("k"), plans.alias("e"), same("k", "e"), "left", few).withColumn("fits", fits)

    near = F.struct(F.abs(F.col("size") - F.col("gap")), "place")
    spare = placed(narrow, ends).filter("NOT fits AND size > 0 AND size < 2 * gap")
    fill = spare.groupBy("k.source").agg(F.min(F.struct(near.alias("near"), "rid")).alias("fill")).select("source", "fill.rid")
    plans = common.cut(ends.alias("e").join(fill.alias("f"), same("e", "f"), "left").select("e.*", F.col("f.rid").alias("fill")), "mix-plans")
    rows = placed(keyed.withColumn("place", place()), plans)
    taken = F.col("fits") | F.coalesce(F.col("rid") == F.col("fill"), F.lit(False))
    return rows.select(*[f"k.{c}" for c in keyed.columns if c not in ("bin", "rid")], "source_size", "target", (F.col("epochs") + taken.cast("long")).alias("copies"))


def mix_plan(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of ``docs``."""
    rows = sized(docs.select(F.struct("doc_id", "text", "source").alias("d")))
    keyed = common.cut(rows.select("d.source", "d.doc_id", "size", "key", F.monotonically_increasing_id().alias("rid")), "mix-keys")
    return selection(keyed).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it is taken, with its own columns."""
    rows = sized(docs.select(F.struct("*").alias("d"))).select("d.source", "d.doc_id", "size", "key", F.monotonically_increasing_id().alias("rid"), "d")
    keyed = common.cut(rows, "mix-rows")
    taken = selection(keyed).filter("copies > 0")
    taken = taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return taken.select("d.*")


SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size
  FROM documents),
q AS (
  SELECT doc_id, source, size, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS symbols,
    (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(text)), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM w),
k AS (
  SELECT doc_id, source, size,
    -ln(u) / CASE WHEN size = 0 THEN 0.25 WHEN symbols * 20 > chars THEN 0.25 WHEN symbols * 100 > chars THEN 0.5 ELSE 1.0 END::DOUBLE AS key
  FROM q),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
g AS (
  SELECT source, source_size, source_size * 2 AS lim,
    CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM s),
f AS (
  SELECT source, source_size, lim, weight, sum(source_size) OVER () * 1.5::DOUBLE AS total, sum(weight) OVER () AS w,
    coalesce(sum(lim) OVER o, 0) AS c, coalesce(sum(weight) OVER o, 0) AS wc
  FROM g
  WINDOW o AS (ORDER BY lim / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, weight * ((total - c) / (w - wc)) AS fair FROM f),
lv AS (SELECT c, wc FROM h WHERE fair <= lim ORDER BY lim / weight, c, wc LIMIT 1),
t AS (
  SELECT h.source, h.source_size,
    CASE WHEN lv.c IS NULL OR fair > lim THEN lim::DOUBLE ELSE h.weight * ((h.total - lv.c) / (h.w - lv.wc)) END AS target
  FROM h LEFT JOIN lv ON true),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
r AS (
  SELECT k.source, k.doc_id, k.size, k.key, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS budget,
    row_number() OVER o AS rn, sum(k.size) OVER o AS upto
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
  WINDOW o AS (PARTITION BY k.source ORDER BY k.key, coalesce(k.doc_id, -1), k.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
m AS (SELECT source, max(budget) - coalesce(sum(size) FILTER (WHERE upto <= budget), 0) AS gap FROM r GROUP BY source),
p AS (
  SELECT r.source, r.rn, row_number() OVER (PARTITION BY r.source ORDER BY abs(r.size - m.gap), r.rn) AS nth
  FROM r JOIN m ON r.source IS NOT DISTINCT FROM m.source WHERE r.upto > r.budget AND r.size > 0 AND r.size < 2 * m.gap)
SELECT r.doc_id, r.size, r.source_size, r.target,
  ((r.epochs + CASE WHEN r.upto <= r.budget OR p.rn IS NOT NULL THEN 1 ELSE 0 END) * r.size)::BIGINT AS taken
FROM r LEFT JOIN p ON r.source IS NOT DISTINCT FROM p.source AND r.rn = p.rn AND p.nth = 1
"""
