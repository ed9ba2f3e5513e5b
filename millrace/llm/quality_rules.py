"""Quality rules: per-document counts, and lines that too many documents of one host share.

The cross-document rule hashes normalised lines, counts for each host the
distinct documents that hold a line, removes lines above the limits, and
rejects documents that lose most of their words that way. It is built of
DataFrame functions only. A line's limit is a small share of its host up to a
fixed number of documents, so it does not grow with a large host.

Texts are normalised once, to a table of line hashes of each distinct content.
What a content loses is joined back by host and digest: to the counts alone
for the report, to the documents for ``keep_good``.

Cases with a defined result:
* null text counts as empty; documents without words fail the base rules;
* a null ``source`` is one host of its own; null ``doc_id`` is carried along;
* rows with equal text on one host are one document for the line counts, so a
  group of exact copies never makes its own lines "frequent"; a line that
  repeats within a text counts once for that text;
* an empty table gives an empty result; extra columns are not read, or (in
  ``keep_good``) are passed through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import common
from millrace.llm.common import let

#: A line is removed on a host where more documents hold it than MIN_LINE_DOCS and than HOST_SHARE of the host's, which counts up to MAX_LINE_DOCS.
MIN_LINE_DOCS = 10
HOST_SHARE = 0.02
MAX_LINE_DOCS = 1000
#: A document is depleted with under this percentage of its words left.
LEFT_PERCENT = 30
MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"


def normalised_lines(text: Column) -> Column:
    """The lines of ``text`` in lower case, digit runs as one 0, white-space runs as one blank, trimmed."""
    for c in common.SPACES[:-1].replace("\n", ""):
        text = F.replace(text, F.lit(c), F.lit(" "))
    text = F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", "0"), " {2,}", " ")
    return F.transform(F.split(text, "\n"), lambda x: F.trim(x))


def repeated_words(words: Column) -> Column:
    """How many of ``words`` lie in ``WINDOW``-word windows found twice or more.

    Hashes say which texts can have such a window (equal windows have equal
    hashes); those texts alone are then compared by the words themselves.
    """
    k = WINDOW

    def exact(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - k)
        windows = F.transform(starts, lambda i: F.struct(F.array_join(F.slice(w, i + 1, k), " ").alias("w"), i.alias("i")))
        return let(F.array_sort(windows), lambda s: let(F.array_sort(twice(s)), covered))

    def twice(s: Column) -> Column:
        at = lambda j: F.get(s, j)["w"]
        same = lambda j: (at(j) == F.coalesce(at(j - 1), F.lit(""))) | (at(j) == F.coalesce(at(j + 1), F.lit("")))
        return F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), same), lambda j: F.get(s, j)["i"])

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, j: F.least(F.lit(k), F.coalesce(F.get(p, j + 1) - x, F.lit(k))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def suspect(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(F.slice(h, i + 1, k)))
        return let(windows, lambda x: F.size(F.array_distinct(x)) < F.size(x))

    maybe = let(F.transform(words, lambda x: F.xxhash64(x)), suspect)
    return F.when(F.size(words) <= k, 0).when(maybe, exact(words)).otherwise(0).cast("long")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))


def content_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("c1"), F.hash(text).alias("c2")]


def lost_lines(docs: DataFrame) -> DataFrame:
    """(host, c1, c2, lost, n_lost): of every content that loses lines, their places in it and how many words they hold."""
    text = F.coalesce("text", F.lit(""))
    words = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    # a line's hash says its host too
    lines = F.transform(normalised_lines(text), lambda x: F.when(x != "", F.struct(F.xxhash64("source", x).alias("line"), words(x).alias("words"))))
    each = docs.select(F.col("source").alias("host"), *content_key(text), lines.alias("lines"))
    contents = each.groupBy("host", "c1", "c2").agg(F.first("lines").alias("lines"))
    contents = common.cut(contents, "host-lines")
    sizes = common.cut(contents.groupBy("host").agg(F.count("*").alias("n_docs")), "host-sizes")
    distinct = F.array_distinct(F.array_compact(F.transform("lines", lambda x: x["line"])))
    counts = contents.select("host", F.explode(distinct).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    limit = F.least(F.col("b.n_docs") * F.lit(HOST_SHARE), F.lit(float(MAX_LINE_DOCS)))
    above = common.joined(counts.filter(F.col("n") > MIN_LINE_DOCS).alias("a"), sizes.alias("b"), F.expr("a.host <=> b.host"), "inner", sizes.count() * 64)
    hot = common.cut(above.filter(F.col("a.n") > limit).select("a.line", "a.n"), "frequent-lines")
    n_hot, total = hot.agg(F.count("*"), F.sum("n")).first()
    found = contents.select("host", "c1", "c2", F.posexplode("lines").alias("at", "x")).select("host", "c1", "c2", "at", "x.line", "x.words")
    if n_hot * 16 <= common.BROADCAST_BYTES:
        found = found.join(F.broadcast(hot.select("line")), "line")
    else:
        found = common.looked_up(found, hot, "line", total)
    return found.groupBy("host", "c1", "c2").agg(F.sort_array(F.collect_list("at")).alias("lost"), F.sum("words").alias("n_lost"))


def scored(docs: DataFrame, carried: Column) -> DataFrame:
    """(d, counts..., base_failed, kept, lost) for every row of ``docs``; ``d`` is ``carried``, ``lost`` the places of its frequent lines or null."""
    text = F.coalesce("text", F.lit(""))
    blank = common.with_spaces(text)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    df = docs.select(
        carried.alias("d"), F.col("source").alias("host"), *content_key(text),
        common.words(text).alias("words"),
        F.length(F.replace(blank, F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
        (F.length(text) - F.length(common.without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    df = df.select(
        "d", "host", "c1", "c2", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )
    lost = common.cut(lost_lines(docs), "lost-lines")
    size = lost.agg(F.sum(F.size("lost") * 4 + 64)).first()[0] or 0
    df = common.joined(df.alias("a"), lost.alias("b"), F.expr("a.host <=> b.host AND a.c1 = b.c1 AND a.c2 = b.c2"), "left", size)
    df = df.select("d", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost", F.coalesce("n_lost", F.lit(0)).alias("n_lost"))
    bad = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)
    depleted = (F.col("n_words") - F.col("n_lost")) * 100 < F.col("n_words") * LEFT_PERCENT
    return df.withColumn("base_failed", bad).withColumn("kept", ~F.col("base_failed") & ~depleted)


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: the counts and the verdict."""
    return scored(docs.select("doc_id", "text", "source"), F.col("doc_id")).select(
        F.col("d").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The kept rows of ``docs`` with all their columns; frequent lines are gone from ``text``, and ``n_chars`` follows."""
    # a predicate over a plain projection would be evaluated below it, with the words split anew at each of their uses
    df = scored(docs, F.struct("*")).withColumn("row", F.monotonically_increasing_id()).filter((F.col("row") >= 0) & F.col("kept"))
    stays = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("lost"))
    left = let(F.split(F.col("d.text"), "\n"), lambda x: F.array_join(F.transform(stays(x), lambda i: F.get(x, i)), "\n"))
    df = df.withColumn("left_text", F.when(F.col("lost").isNull(), F.col("d.text")).otherwise(left))
    new = {"text": F.col("left_text"), "n_chars": F.length(F.coalesce("left_text", F.lit(""))).cast("long")}
    return df.select(*[(new[c] if c in new else F.col("d")[c]).alias(c) for c in docs.columns])


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
win AS (
  SELECT rid, i, array_to_string(words[i + 1:i + 8], ' ') AS win
  FROM (SELECT rid, words, unnest(range(0, len(words) - 7)) AS i FROM w)),
dup AS (SELECT rid, unnest(list_concat(list(i))) AS i FROM win GROUP BY rid, win HAVING count(*) > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM dup) GROUP BY rid),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (
  SELECT rid, line,
    trim(regexp_replace(regexp_replace(regexp_replace(lower(line), '[\x20\x09-\x0D]', ' ', 'g'), '[0-9]+', '0', 'g'), ' {2,}', ' ', 'g'), ' ') AS norm
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dl AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lw GROUP BY rid),
contents AS (SELECT min(rid) AS rid, source FROM d GROUP BY source, text),
hosts AS (SELECT source, count(*) AS n_docs FROM contents GROUP BY source),
freq AS (
  SELECT c.source, lw.norm, count(DISTINCT lw.rid) AS n FROM lw JOIN contents c ON lw.rid = c.rid GROUP BY c.source, lw.norm),
hot AS (
  SELECT f.source, f.norm FROM freq f JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source
  WHERE f.n > 10 AND f.n > least(h.n_docs * 0.02, 1000)),
lost AS (
  SELECT lw.rid, sum(len(list_filter(regexp_split_to_array(lw.line, '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS n
  FROM lw JOIN d ON d.rid = lw.rid JOIN hot ON hot.norm = lw.norm AND hot.source IS NOT DISTINCT FROM d.source
  GROUP BY lw.rid),
c AS (
  SELECT d.doc_id, len(w.words)::BIGINT AS n_words,
    length(regexp_replace(d.text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(dl.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0) AS n_lost
  FROM d JOIN w USING (rid) LEFT JOIN dl USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN lost USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * (n_words - n_lost) >= 30 * n_words AS kept
FROM c
"""
