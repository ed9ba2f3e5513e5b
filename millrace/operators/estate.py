"""Retrieval of dependencies as joins: plans, lookups, outcomes, replays, vocabularies.

What came back is always one of several statuses, never a bare null: a member
that was asked for and is not there, one whose request failed, and one that was
never asked for stay apart. Inputs carry an ordinal, and outputs keep its order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from millrace.sources.members import canonical_type, member_key

MEMBER_NAME = "(?i)^[A-Z0-9$#@][A-Z0-9$#@._-]{0,43}$"
DATASET_MEMBER = "(?i)^[A-Z0-9$#@.-]+\\(([A-Z0-9$#@]{1,8})\\)$"
#: The types a program is asked for in turn, and the type of each kind of artifact.
PROGRAM_TYPES = ["cobol", "asm"]
KIND_TYPE = {
    "program": "cobol", "copybook": "copybook", "db2-table": "ddl", "db2-type": "ddl", "db2-stored-procedure": "cobol", "file": "cntl",
    "terminal-map": "bms", "cics-transaction": "csd", "queue": "csd", "proc": "proc", "include-member": "cntl", "control-card": "cntl",
    "dataset": "cntl", "autoedit-member": "cntl", "macro": "macro",
}
NEVER_FETCHABLE = ["caller", "spool", "db2-tablespace"]
NON_FETCHABLE = ["internal-nested", "ibm-runtime"]
MANIFEST_KINDS = (
    "program copybook macro db2-table db2-type db2-stored-procedure db2-tablespace db2-dynamic-sql file dataset ims-segment cics-transaction terminal-map queue "
    "cics-partitionset cics-library cics-profile cics-tranclass cics-lsrpool cics-journalmodel cics-connection cics-terminal cics-typeterm cics-urimap "
    "cics-tcpipservice cics-pipeline cics-webservice cics-db2entry cics-jvmserver cics-bundle cics-processtype cics-doctemplate proc include-member "
    "control-card autoedit-member caller spool"
).split()
HOST_KINDS = {
    "PROGRAM": "program", "MODULE": "program", "ENTRY": "program", "ENTRY-POINT": "program", "COPYBOOK": "copybook", "FILE": "file", "DATASET": "dataset",
    "MAP": "terminal-map", "MAPSET": "terminal-map", "TDQUEUE": "queue", "TSQUEUE": "queue", "TSMODEL": "queue", "TRANSACTION": "cics-transaction",
    "PARTITIONSET": "cics-partitionset", "LIBRARY": "cics-library", "CONNECTION": "cics-connection", "IPCONN": "cics-connection", "TERMINAL": "cics-terminal",
    "URIMAP": "cics-urimap", "BUNDLE": "cics-bundle", "DOCTEMPLATE": "cics-doctemplate", "TABLE": "db2-table", "PROCEDURE": "db2-stored-procedure",
    "JOB": "proc", "PROC": "proc",
}
DEPENDENCY_VALUES = ["runtime", "compile-time"]
IDENTITY_VALUES = ["global", "program-local", "job-scoped", "library-member", "internal", "runtime"]
IO_VALUES = ["read", "write", "read-write", "read+write", "unknown"]
MATCH_STRENGTHS = ["qualified", "schema-unconstrained", "bare"]


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map([F.lit(x) for pair in pairs.items() for x in pair])


def manifest_kind(kind: Column) -> Column:
    """A kind in the manifest's words, from those or a host's; unknown ones are null, never guessed."""
    text = F.trim(kind)
    return F.when(F.lower(text).isin(MANIFEST_KINDS), F.lower(text)).otherwise(literal_map(HOST_KINDS)[F.upper(text)])


def request_type(kind: Column) -> Column:
    return literal_map(KIND_TYPE)[kind]


# ---- plans


def fetch_plan(manifest: DataFrame) -> DataFrame:
    """One row per manifest row: what to request, under which types, or why not.

    ``manifest`` is (seq, artifact, kind, dependency, classification, dynamic,
    dataset, ddname). A program's language is not assumed: it is asked for as
    each of ``PROGRAM_TYPES``. The reasons are never-fetchable, not-fetchable,
    dynamic-name, unbound-file, unknown-kind and not-a-member-name.
    """
    a = F.col("artifact")
    member = F.upper(F.regexp_extract(a, DATASET_MEMBER, 1))
    bound = F.coalesce(F.nullif("dataset", F.lit("")), F.nullif("ddname", F.lit("")))
    reason = (
        F.when(F.col("kind").isin(NEVER_FETCHABLE), "never-fetchable")
        .when(F.col("classification").isin(NON_FETCHABLE), "not-fetchable")
        .when(F.col("dynamic"), "dynamic-name")
        .when((F.col("kind") == "file") & bound.isNull(), "unbound-file")
        .when(request_type(F.col("kind")).isNull(), "unknown-kind")
        .when((F.col("kind") != "file") & (member == "") & ~a.rlike(MEMBER_NAME), "not-a-member-name")
    )
    request = F.when(reason.isNull(), F.when(F.col("kind") == "file", bound).when(member != "", member).otherwise(a))
    types = F.when(reason.isNull(), F.when(F.col("kind") == "program", F.array(*[F.lit(t) for t in PROGRAM_TYPES])).otherwise(F.array(request_type(F.col("kind")))))
    named_as = F.when(request != a, F.when(request == F.col("dataset"), "dataset").when(member != "", "member").otherwise("ddname"))
    return manifest.select(
        "seq", "artifact", "kind", "dependency", "classification", F.when(reason.isNull(), "planned").otherwise("skipped").alias("status"),
        reason.alias("reason"), request.alias("request"), types.alias("types"), named_as.alias("requested_as"),
    )


def candidate_plan(calls: DataFrame) -> DataFrame:
    """Requests for the candidates of dynamic calls (seq, item, candidates, declared_candidates), graded assigned or declared-88."""
    graded = F.concat(
        F.transform(F.coalesce("candidates", F.array()), lambda x: F.struct(x.alias("name"), F.lit("assigned").alias("evidence"))),
        F.transform(F.coalesce("declared_candidates", F.array()), lambda x: F.struct(x.alias("name"), F.lit("declared-88").alias("evidence"))),
    )
    each = calls.select("seq", "item", F.posexplode(graded).alias("pos", "x")).select("seq", "pos", "item", member_key(F.col("x.name")).alias("request"), "x.evidence")
    return each.filter(F.col("request").rlike(MEMBER_NAME)).withColumn("types", F.array(*[F.lit(t) for t in PROGRAM_TYPES]))


def stored(asks: DataFrame, store: DataFrame) -> DataFrame:
    """``asks`` (seq, name, asked_type) with ``hit``, the entry (source, text) of the store that answers it, or null.

    ``store`` is (member, asked_type, ord, text, source): the asked type is part
    of its key. An entry without type serves any ask, an ask without type the
    first entry; of DSN(MEMBER) the whole is looked up before the member.
    Repeated ``seq`` do no harm: a hit goes by name and type.
    """
    key = member_key(F.col("name"))
    inner = F.upper(F.regexp_extract(key, DATASET_MEMBER, 1))
    names = F.when(inner != "", F.array(key, inner)).otherwise(F.array(key))
    # an answer is a matter of name and type alone: each pair is looked up once, whatever asks for it
    pairs = asks.select("name", "asked_type").distinct()
    each = pairs.select("name", "asked_type", F.posexplode(names).alias("nth", "key")).alias("a")
    grade = F.expr("CASE WHEN a.asked_type <=> s.asked_type THEN 0 WHEN s.asked_type IS NULL THEN 1 WHEN a.asked_type IS NULL THEN 2 END")
    found = each.join(store.alias("s"), F.expr("a.key = s.member")).withColumn("grade", grade).filter("grade IS NOT NULL")
    order = F.struct("a.nth", "grade", "s.ord", F.struct("s.source", "s.text").alias("hit"))
    best = found.groupBy("a.name", "a.asked_type").agg(F.min(order).alias("best")).select("name", "asked_type", F.col("best.hit").alias("hit"))
    return asks.alias("q").join(best.alias("b"), F.expr("q.name = b.name AND q.asked_type <=> b.asked_type"), "left").select("q.*", "b.hit")


# ---- outcomes


def first_answers(answers: DataFrame) -> DataFrame:
    """Of the answers recorded for one (name, asked_type) the first by seq; of several with one seq the least by their other columns."""
    rest = [c for c in answers.columns if c not in ("name", "asked_type", "seq")]
    first = answers.groupBy("name", "asked_type").agg(F.min(F.struct("seq", *rest)).alias("x"))
    return first.select(*[c if c in ("name", "asked_type") else F.col(f"x.{c}").alias(c) for c in answers.columns])


def with_first(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``is_first``: one row of each combination of ``keys`` (nulls are equal), the one with the least seq.

    The least seq is pre-aggregated, so that a combination may hold any share
    of the rows; rows that repeat their seq too are told apart among themselves.
    """
    least = rows.groupBy(*keys).agg(F.min("seq").alias("least"))
    same = F.expr(" AND ".join(f"r.`{k}` <=> m.`{k}`" for k in keys))
    rest = [c for c in rows.columns if c not in keys and c != "seq"]
    nth = F.row_number().over(W.partitionBy(*keys, "seq").orderBy(*(rest or ["seq"])))
    marked = rows.alias("r").join(least.alias("m"), same).select("r.*", "m.least").withColumn("nth", nth)
    return marked.withColumn("is_first", F.coalesce((F.col("seq") == F.col("least")) & (F.col("nth") == 1), F.lit(False))).drop("least", "nth")


def replayed(asks: DataFrame, answers: DataFrame) -> DataFrame:
    """(seq, name, asked_type, outcome, text, source): each ask answered as recorded; one that was never recorded is ``no-record``, which is no absence."""
    kept = first_answers(answers.select("seq", member_key(F.col("name")).alias("name"), "asked_type", "outcome", "text", "source")).drop("seq")
    same = F.expr("a.name = b.name AND a.asked_type <=> b.asked_type")
    rows = asks.select("seq", member_key(F.col("name")).alias("name"), "asked_type").alias("a").join(kept.alias("b"), same, "left")
    return rows.select("a.*", F.coalesce("b.outcome", F.lit("no-record")).alias("outcome"), "b.text", "b.source")


def fetched(plan: DataFrame, subject: str, store: DataFrame, answers: DataFrame | None) -> DataFrame:
    """``plan`` with each row's status after retrieval.

    In this order: a skipped row stays so; the subject is no dependency of
    itself; a row like an earlier one (name and types) has its outcome,
    ``already-fetched`` if it was retrieved; a stored member was prefetched;
    without a service (``answers`` None) it was never looked for; else the
    first of its types that was found, an error, or not found. A language is
    stated only where an answer proves it.
    """
    planned = plan.withColumn("name", F.upper("request")).filter("status = 'planned'")
    asks = planned.select("name", "types").distinct().select("name", "types", F.posexplode("types").alias("probe", "asked_type"))
    hits = stored(asks, store).filter("hit IS NOT NULL").groupBy("name", "types").agg(F.min(F.struct("probe", "hit")).alias("h")).select("name", "types", "h.hit")
    none = F.lit(None).cast("string")
    if answers is None:
        asked = asks.groupBy("name", "types").agg(F.lit("no-service").alias("outcome")).select("*", *[none.alias(c) for c in ("source", "detected_type", "shown_type")])
    else:
        known = first_answers(answers.select("seq", F.upper("name").alias("name"), "asked_type", "outcome", "source", "detected_type")).drop("seq")
        each = asks.join(known, ["name", "asked_type"], "left")
        # the first type that is found ends the probing; an error before it ends it too
        step = F.struct("probe", F.when(F.col("outcome") == "found", "fetched").when(F.col("outcome") == "error", "error").alias("outcome"), "source", "detected_type", "asked_type")
        asked = each.groupBy("name", "types").agg(F.min(F.when(F.col("outcome").isin("found", "error"), step)).alias("s"))
        asked = asked.select("name", "types", F.coalesce("s.outcome", F.lit("not-found")).alias("outcome"), "s.source", "s.detected_type", F.col("s.asked_type").alias("shown_type"))
    ends = asked.join(hits, ["name", "types"], "left").select(
        "name", "types", F.when(F.col("hit").isNotNull(), "prefetched").otherwise(F.col("outcome")).alias("end"),
        F.coalesce("hit.source", "source").alias("source"), F.when(F.col("hit").isNull(), F.coalesce("detected_type", "shown_type")).alias("shown"),
        F.col("detected_type").isNotNull().alias("told"),
    )
    out = with_first(planned, ["name", "types"]).join(ends, ["name", "types"], "left")
    is_subject = F.col("name") == subject.upper()
    own = F.col("is_first") & ~is_subject
    status = (
        F.when(is_subject, "subject").when(own, F.col("end"))
        .when(F.col("end").isin("fetched", "prefetched"), "already-fetched").otherwise(F.col("end"))
    )
    language = F.when((F.size("types") > 1) & own & (F.col("end") == "fetched"), canonical_type(F.col("shown")))
    basis = F.when(language.isNotNull(), F.when(F.col("told"), "detected").otherwise("probed"))
    proven = F.when((F.col("kind") == "program") & (language == "cobol"), "cobol-program").when((F.col("kind") == "program") & (language == "asm"), "assembler-program")
    # what was not asked for is not joined: skipped rows share no name
    skipped = plan.filter("status <> 'planned'").select(
        "seq", "artifact", "kind", "dependency", "request", "status", "reason", none.alias("source"), none.alias("language"), none.alias("language_basis"), "classification"
    )
    return out.select(
        "seq", "artifact", "kind", "dependency", "request", status.alias("status"), "reason", F.when(own, F.col("source")).alias("source"),
        language.alias("language"), basis.alias("language_basis"), F.coalesce(proven, "classification").alias("classification"),
    ).unionByName(skipped)


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def prefetched(asks: DataFrame, local: DataFrame, seeded: DataFrame, answers: DataFrame | None) -> DataFrame:
    """(seq, member, dataset, asked_type, status, source) of asks for members that complete a source.

    ``local`` is (member, rank, source), ``seeded`` (member): names settled
    before. A name asked for again under the same type is ``seen``.
    """
    key = member_key(F.col("name"))
    inner = F.upper(F.regexp_extract(key, DATASET_MEMBER, 1))
    rows = asks.select("seq", "asked_type", key.alias("key"), F.when(inner != "", inner).otherwise(key).alias("member"), F.when(inner != "", key).alias("dataset"))
    rows = with_first(rows, ["key", "asked_type"])
    rows = rows.join(seeded.select(member_key(F.col("member")).alias("key"), F.lit(True).alias("settled")).distinct(), "key", "left")
    best = local.groupBy(F.upper("member").alias("member")).agg(F.min_by("source", "rank").alias("local"))
    rows = rows.join(best, "member", "left")
    if answers is None:
        rows = rows.withColumn("outcome", F.lit("no-service")).withColumn("source", F.lit(None).cast("string"))
    else:
        known = first_answers(answers.select("seq", member_key(F.col("name")).alias("name"), "asked_type", "outcome", "source")).drop("seq")
        rows = rows.alias("a").join(known.alias("b"), F.expr("a.member = b.name AND a.asked_type <=> b.asked_type"), "left")
        rows = rows.select("a.*", F.when(F.col("b.outcome") == "found", "fetched").otherwise(F.coalesce("b.outcome", F.lit("not-found"))).alias("outcome"), "b.source")
    status = (
        F.when(~F.col("is_first") | F.col("settled"), "seen").when(F.col("dataset").isNull() & ~F.col("key").rlike(MEMBER_NAME), "skipped")
        .when(F.col("local").isNotNull(), "local").otherwise(F.col("outcome"))
    )
    rows = rows.withColumn("status", status)
    return rows.select("seq", "member", "dataset", "asked_type", "status", F.when(F.col("status") == "local", F.col("local")).when(F.col("status") == "fetched", F.col("source")).alias("source"))


# ---- lookups


def synonyms(names: DataFrame, mapping: DataFrame, resolver: DataFrame | None = None) -> DataFrame:
    """(name, base, door): the base that a synonym stands for by the map, else by the resolver's table; null where neither has one."""
    rows = names.select(F.upper("name").alias("name")).join(mapping.select(F.upper("name").alias("name"), F.upper("base").alias("mapped")), "name", "left")
    if resolver is None:
        rows = rows.withColumn("resolved", F.lit(None).cast("string"))
    else:
        rows = rows.join(resolver.select(F.upper("name").alias("name"), F.upper(F.trim("base")).alias("resolved")), "name", "left")
    return rows.select("name", F.coalesce("mapped", "resolved").alias("base"), F.when(F.col("mapped").isNotNull(), "map").when(F.col("resolved").isNotNull(), "resolver").alias("door"))


def dependents(asks: DataFrame, coverage: DataFrame, edges: DataFrame) -> DataFrame:
    """(seq, name, kind, answer_status, rows): who depends on a name.

    ``coverage`` is (name, kind or null): what was asked about at all; ``edges``
    (of_name, of_kind, name, kind, via, match_strength, detail). A covered name
    without edges is ``answered`` with no rows, one that is not covered
    ``not-answered``; an edge of unknown kind or strength, or without a name,
    makes the answer ``broken``. An ask without kind is answered if one kind
    only is covered.
    """
    kind = manifest_kind(F.col("kind"))
    covered = coverage.select(member_key(F.col("name")).alias("key"), kind.alias("of")).distinct()
    asked = asks.select("seq", member_key(F.col("name")).alias("name"), kind.alias("kind"))
    one = covered.withColumn("kinds", F.count("*").over(W.partitionBy("key")))
    grade = F.expr("CASE WHEN kind <=> of THEN 0 WHEN of IS NULL THEN 1 WHEN kind IS NULL AND kinds = 1 THEN 2 END")
    found = asked.select("name", "kind").distinct().join(one, F.expr("name = key")).withColumn("grade", grade).filter("grade IS NOT NULL")
    found = found.groupBy("name", "kind").agg(F.min(F.struct("grade", "key", "of")).alias("m")).select("name", "kind", "m.key", "m.of", F.lit(True).alias("covered"))
    coarse = manifest_kind(F.col("kind"))
    bad = coarse.isNull() | (F.coalesce(F.trim("name"), F.lit("")) == "") | (F.col("match_strength").isNotNull() & ~F.col("match_strength").isin(MATCH_STRENGTHS))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    row = F.struct(member_key(F.col("name")).alias("name"), F.coalesce(blank("via"), F.lit("")).alias("via"), F.upper(F.trim("kind")).alias("kind"), coarse.alias("manifest_kind"), F.col("match_strength"), blank("detail").alias("detail"))
    grouped = edges.groupBy(member_key(F.col("of_name")).alias("key"), manifest_kind(F.col("of_kind")).alias("of")).agg(F.max(bad).alias("bad"), F.sort_array(F.collect_list(row)).alias("rows"))
    held = asked.alias("q").join(found.alias("f"), F.expr("q.name = f.name AND q.kind <=> f.kind"), "left").select("q.*", "f.key", "f.of", "f.covered")
    out = held.alias("a").join(grouped.alias("g"), F.expr("a.key = g.key AND a.of <=> g.of"), "left")
    status = F.when(F.col("covered").isNull(), "not-answered").when(F.col("bad"), "broken").otherwise("answered")
    rows = F.when(status == "answered", F.coalesce("rows", F.array()))
    return out.select("a.seq", "a.name", "a.kind", status.alias("answer_status"), rows.alias("rows"))


def complaints(manifest: DataFrame) -> DataFrame:
    """(seq, complaint) of manifest rows (seq, artifact, kind, dependency, identity, io, needs, resolved_by): advisory, nothing is dropped."""
    c = F.col
    rules = [F.when(c(k).isNull(), f"no {k}") for k in ("artifact", "kind", "dependency", "identity")]
    rules += [F.when(~c(k).isin(allowed), F.concat(F.lit(f"{k}="), c(k))) for k, allowed in (("dependency", DEPENDENCY_VALUES), ("identity", IDENTITY_VALUES), ("io", IO_VALUES))]
    rules += [F.when(c(k) == "", f"empty {k}") for k in ("needs", "resolved_by")]
    return manifest.select("seq", F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("complaint"))


# ---- comparisons


def ratchet(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, change) between two digest tables (key, digest): MISSING, ADDED or CHANGED."""
    a, b = before.select("key", F.col("digest").alias("a")), after.select("key", F.col("digest").alias("b"))
    change = F.when(F.col("b").isNull(), "MISSING").when(F.col("a").isNull(), "ADDED").when(F.col("a") != F.col("b"), "CHANGED")
    return a.join(b, "key", "full").select("key", change.alias("change")).filter("change IS NOT NULL")


def producer_diff(native: DataFrame, external: DataFrame, error_paragraphs: DataFrame) -> DataFrame:
    """(member, line, outcome, in_error_paragraph) of the lines where either of two parsers saw a statement.

    Both are (member, line, verb); a native verb ``?`` is an opaque one. The
    outcomes are agree-typed, agree-opaque, missed-by-native and
    missed-by-external; an error paragraph holds the lines from its own to the
    next paragraph's, (member, from_line, to_line).
    """
    ours = native.groupBy("member", "line").agg(F.min(F.col("verb") == "?").alias("opaque"))
    theirs = external.select("member", "line", F.lit(True).alias("theirs")).distinct()
    lines = ours.join(theirs, ["member", "line"], "full")
    outcome = F.when(F.col("opaque").isNull(), "missed-by-native").when(F.col("theirs").isNull(), "missed-by-external").when(F.col("opaque"), "agree-opaque").otherwise("agree-typed")
    lines = lines.select("member", "line", outcome.alias("outcome"))
    # a range condition within a member; its paragraphs are few, lines many
    inside = lines.alias("l").join(error_paragraphs.alias("p"), F.expr("l.member = p.member AND l.line >= p.from_line AND l.line < p.to_line"), "left_semi")
    return lines.join(inside.select("member", "line", F.lit(True).alias("inside")), ["member", "line"], "left").select("member", "line", "outcome", F.coalesce("inside", F.lit(False)).alias("in_error_paragraph"))


def first_by(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The value with the least ``order`` of each key (first wins)."""
    return rows.groupBy(*keys).agg(F.min_by(value, order).alias(value))


def last_by(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The value with the greatest ``order`` of each key (last wins)."""
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(value))
