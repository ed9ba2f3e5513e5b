"""COBOL members as tables: format, lines, tokens, programs, statements, data items, SQL facts, calls.

The format decision is array expressions over the member's row. Line stitching,
COPY, and the statement grammar are sequential within a member, so they are
Python over Arrow batches of whole members; a program is parsed once
(``parsed``), and the flat tables are read off the parsed rows. COPY closures
and call resolution are joins.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window as W

from millrace.functions import cobol_parse as cp
from millrace.functions import cobol_rows as rows
from millrace.functions import cobol_text as ct
from millrace.functions.shipping import column_values, map_arrow, pieces
from millrace.operators.closure import reachable
from millrace.sources.members import by_work, cobol_lines, member_key
from millrace.sources.shared import cut

PARSED = "member string, format string, source_name string, text string, program string, copybook_errors array<array<string>>"
#: What a program is parsed from.
UNPARSED = ["text", "format", "books", "failed"]
HEADER = "(?iU)\\b(IDENTIFICATION|ENVIRONMENT|DATA|PROCEDURE)\\s+DIVISION\\b"


def detected(text: Column) -> Column:
    """(format, confidence, reason) of a source.

    In this order: a directive in the first 200 lines; column 7 holds an
    indicator on every line; the column of a DIVISION header; a line beyond 80
    columns; program text in column 7 on 15 % of the lines or more; else fixed.
    """
    lines = cobol_lines(text)
    blank = lambda x: ~x.rlike("(?U)\\S")
    directive = F.transform(F.slice(lines, 1, 200), lambda x: F.when(F.contains(F.replace(F.upper(x), F.lit(" "), F.lit("")), F.lit("SOURCEFORMAT")), F.when(F.contains(F.upper(x), F.lit("FREE")), "free").when(F.contains(F.upper(x), F.lit("FIXED")), "fixed")))
    said = F.get(F.filter(directive, lambda x: x.isNotNull()), 0)
    seen = F.filter(lines, lambda x: ~blank(x))
    mark = lambda x: F.when(F.length(x) > 6, F.substring(x, 7, 1)).otherwise(" ")
    count = lambda test: F.size(F.filter(seen, test))
    n, comments, wrong = F.size(seen), count(lambda x: mark(x).isin("*", "/", "-")), count(lambda x: ~mark(x).isin(*" */-Dd$"))
    column = F.transform(F.filter(lines, lambda x: x.rlike(HEADER)), lambda x: F.length(F.regexp_extract(x, f"^(.*?)(?={HEADER})", 1)) + 1)
    head = F.get(F.filter(F.transform(column, lambda c: F.when(c == 8, "fixed").when(c <= 4, "free")), lambda x: x.isNotNull()), 0)
    long = F.exists(lines, lambda x: F.length(F.regexp_replace(x, "(?U)\\s+$", "")) > 80)
    ratio = F.when(n > 0, wrong / n).otherwise(0.0)
    verdict = lambda kind, confidence, reason: F.struct(kind.alias("format"), confidence.cast("double").alias("confidence"), reason.alias("reason"))
    incl = F.when(comments > 0, F.format_string(", %d of them a comment or continuation", comments)).otherwise("")
    return (
        F.when(said.isNotNull(), verdict(said, F.lit(1.0), F.lit("a directive says so")))
        .when((n > 0) & (wrong == 0), verdict(F.lit("fixed"), F.lit(0.97), F.concat(F.format_string("each of %d lines has an indicator in column 7", n), incl)))
        .when(head.isNotNull(), verdict(head, F.lit(0.95), F.lit("where a division header begins")))
        .when(long, verdict(F.lit("free"), F.lit(0.85), F.lit("a line goes beyond column 80")))
        .when(ratio >= 0.15, verdict(F.lit("free"), F.least(F.lit(0.9), ratio + 0.6), F.format_string("%d of %d lines have program text in column 7", wrong, n)))
        .otherwise(verdict(F.lit("fixed"), F.when(wrong > 0, 0.6).otherwise(0.7), F.lit("nothing speaks for free format")))
    )


def format_detection(members: DataFrame) -> DataFrame:
    """(member, format, confidence, reason) of each member."""
    return members.select("member", F.explode(F.array(detected(F.coalesce("text", F.lit("")))))).select("member", "col.*")


def with_format(members: DataFrame) -> DataFrame:
    """``members`` with a format: the given one, else the detected one."""
    if "format" in members.columns:
        return members.withColumn("format", F.coalesce("format", detected(F.coalesce("text", F.lit("")))["format"]))
    return members.withColumn("format", detected(F.coalesce("text", F.lit("")))["format"])


def _flat(make: Callable[..., Iterator[dict]], inputs: list[str], schema: T.StructType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [(f.name, to_arrow_type(f.dataType)) for f in schema.fields]
    kept = pa.schema(fields)
    names = kept.names[1:] if kept.names[:1] == ["member"] else kept.names

    def read() -> Iterator[tuple]:
        for batch in batches:
            for member, *values in column_values(batch, *inputs):
                own = (member,) if len(names) < len(kept) else ()
                for row in make(*values):
                    yield *own, *map(row.get, names)

    for piece in pieces(read()):
        columns = zip(*piece, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kept, strict=True)], schema=kept)


def flat(df: DataFrame, make: Callable[..., Iterator[dict]], inputs: list[str], schema: str, columns: list[str] | None = None) -> DataFrame:
    """Rows ``make(*inputs)`` of each row of ``df``, with its member; only ``columns`` of them, if they are given."""
    made = T.StructType.fromDDL("member string, " + schema)
    if columns is not None:
        made = T.StructType([f for f in made.fields if f.name in columns])
    return map_arrow(df.select("member", *inputs), partial(_flat, make, ["member", *inputs], made), made)


def _line_rows(text: str | None, fmt: str) -> Iterator[dict]:
    for i, x in enumerate(ct.logical_lines(text or "", fmt == "fixed")):
        yield {"ln_ix": i, "line": x.line, "text": x.text, "area_a": x.area_a, "origin": x.origin}


def code_lines(members: DataFrame) -> DataFrame:
    """Logical lines: no margins, comments or continuations."""
    return flat(by_work(with_format(members)), _line_rows, ["text", "format"], "ln_ix int, line int, text string, area_a boolean, origin string")


def _token_rows(text: str | None, fmt: str) -> Iterator[dict]:
    for i, t in enumerate(ct.tokens(ct.logical_lines(text or "", fmt == "fixed"))):
        yield {"tok_ix": i, "text": t.text, "up": t.up, "kind": t.kind, "line": t.line, "origin": t.origin}


def tokens(members: DataFrame) -> DataFrame:
    """Tokens of the logical lines."""
    return flat(by_work(with_format(members)), _token_rows, ["text", "format"], "tok_ix int, text string, up string, kind string, line int, origin string")


# ---- copybooks


def _copy_rows(text: str | None, fmt: str) -> Iterator[dict]:
    for i, name in enumerate(ct.copy_members(text or "", fmt == "fixed")):
        yield {"ord": i, "copy_member": name}


def copy_edges(members: DataFrame) -> DataFrame:
    """(member, ord, copy_member): what each member copies or includes, each once, in order; nothing is retrieved."""
    return flat(with_format(members), _copy_rows, ["text", "format"], "ord int, copy_member string")


def ranked_library(library: DataFrame, order: list[str]) -> DataFrame:
    """The first (member, text, source) of each member of a library by ``order``; members are compared without case."""
    best = F.row_number().over(W.partitionBy("member").orderBy(*order, "source"))
    rows = library.withColumn("member", member_key(F.col("member"))).withColumn("nth", best).filter("nth = 1")
    return rows.select("member", "text", "source")


def one_each(library: DataFrame) -> DataFrame:
    """(member, text, source) of a library, one row a member: the least source and text where it was not ranked before."""
    best = library.groupBy("member").agg(F.min(F.struct("source", "text")).alias("x"))
    return best.select("member", "x.text", "x.source")


def copy_closure(programs: DataFrame, library: DataFrame) -> DataFrame:
    """(member, copy_member, depth, status): all copybooks a program needs, directly or not, and whether the library has them."""
    known = one_each(library).select(F.col("member").alias("src"), "text")
    of_library = copy_edges(known.select(F.col("src").alias("member"), "text")).select(F.col("member").alias("src"), F.col("copy_member").alias("dst"))
    first = copy_edges(programs).select("member", F.col("copy_member").alias("root")).distinct()
    found = _by_program(cut(first, "copy-roots"), cut(of_library, "copy-edges"))
    have = known.select(F.col("src").alias("copy_member"), F.lit("expanded").alias("status"))
    return found.join(have, "copy_member", "left").select("member", "copy_member", "depth", F.coalesce("status", F.lit("missing")).alias("status"))


def _by_program(first: DataFrame, edges: DataFrame) -> DataFrame:
    """(member, copy_member, depth): the closure is taken once per copybook, then joined to the programs that begin it."""
    reach = reachable(first.select("root"), edges)
    return first.join(reach, "root").groupBy("member", F.col("node").alias("copy_member")).agg((F.min("depth") + 1).alias("depth"))


def _program(text: str | None, fmt: str, books: list[dict] | None, errors: dict[str, str]) -> dict:
    library = {b["name"]: (b["text"], b["source"]) for b in books or ()}
    return cp.program(text or "", fmt == "fixed", library.get, errors)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch a member: trees are several times their text."""
    for batch in batches:
        for i, (text, fmt, books, failed) in enumerate(column_values(batch, *UNPARSED)):
            errors = {x["name"]: x["error"] for x in failed or ()}
            made = _program(text, fmt, books, errors)
            missing = dict.fromkeys(x["member"] for x in made["copybooks"] if x["status"] == "missing")
            kept = [batch.column(c).slice(i, 1) for c in ("member", "format", "source_name", "text")]
            failures = [[x, errors[x]] for x in missing if x in errors]
            arrays = [*kept, pa.array([json.dumps(made)], pa.string()), pa.array([failures], pa.list_(pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays(arrays, ["member", "format", "source_name", "text", "program", "copybook_errors"])


def parsed(members: DataFrame, library: DataFrame | None = None, errors: DataFrame | None = None) -> DataFrame:
    """(member, format, source_name, text, program, copybook_errors): each member's program as a JSON tree.

    ``library`` is (member, text, source). A program's row brings just the
    copybooks of its own closure to the worker. ``errors`` is (member, error) of
    copybooks whose retrieval failed: a program that misses one has the pair in
    ``copybook_errors``, in the order of its COPY statements.
    """
    rows_ = with_format(members)
    name = F.col("source_name") if "source_name" in members.columns else F.col("member")
    rows_ = by_work(rows_.select("member", "format", name.alias("source_name"), "text"))
    none = lambda kind: F.lit(None).cast(f"array<struct<{kind}>>")
    rows_ = rows_.withColumn("books", none("name:string,text:string,source:string")).withColumn("failed", none("name:string,error:string"))
    if library is not None:
        library = one_each(library)
        closure = copy_closure(members, library)
        if errors is not None:
            closure = cut(closure, "copy-closure")
        needed = closure.filter("status = 'expanded'").select("member", "copy_member")
        books = needed.join(library.select(F.col("member").alias("copy_member"), "text", "source"), "copy_member")
        books = books.groupBy("member").agg(F.collect_list(F.struct(F.col("copy_member").alias("name"), "text", "source")).alias("books"))
        rows_ = rows_.drop("books").join(books, "member", "left")
        if errors is not None:
            known = errors.groupBy(member_key(F.col("member")).alias("copy_member")).agg(F.min("error").alias("error"))
            failed = closure.filter("status = 'missing'").join(known, "copy_member")
            failed = failed.groupBy("member").agg(F.sort_array(F.collect_list(F.struct(F.col("copy_member").alias("name"), "error"))).alias("failed"))
            rows_ = rows_.drop("failed").join(failed, "member", "left")
    out = map_arrow(rows_.select("member", "format", "source_name", "text", "books", "failed"), _parse, PARSED)
    out.unparsed = rows_  # one table alone is read off the tree where it is made, see ``_table``
    return out


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("source_name", "text", "format", "program", "copybook_errors")]
        texts = [cp.bundle_text(n, t or "", f == "fixed", json.loads(p), e or ()) for n, t, f, p, e in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("member"), pa.array(texts, pa.string())], ["member", "bundle"])


def bundles(programs: DataFrame) -> DataFrame:
    """(member, bundle): each parsed program as a parse bundle's text."""
    return map_arrow(programs.select("member", "source_name", "text", "format", "program", "copybook_errors"), _bundles, "member string, bundle string")


def checked_bundle(text: Column, source: Column) -> Column:
    """``ok``, or why a bundle is not read, as far as columns tell: foreign, newer, incomplete, stale."""
    at = lambda path: F.get_json_object(text, path)
    return (
        F.when(at("$.format").isNull() | (at("$.format") != cp.BUNDLE_FORMAT), "foreign")
        .when(at("$.version").try_cast("int").isNull() | (at("$.version").try_cast("int") > cp.BUNDLE_VERSION), "newer")
        .when(at("$.program").isNull() | at("$.source.sha256").isNull() | at("$.source.text").isNull(), "incomplete")
        .when(at("$.source.sha256") != F.sha2(source.cast("binary"), 256), "stale")
        .otherwise("ok")
    )


# ---- tables of parsed programs


def _of_program(make: Callable[[dict], Iterator[dict]], text: str) -> Iterator[dict]:
    return make(json.loads(text))


def _of_source(make: Callable[[dict], Iterator[dict]], text: str | None, fmt: str, books: list[dict] | None, failed: list[dict] | None) -> Iterator[dict]:
    return make(_program(text, fmt, books, {x["name"]: x["error"] for x in failed or ()}))


def _table(programs: DataFrame, make: Callable[[dict], Iterator[dict]], schema: str, columns: list[str] | None = None) -> DataFrame:
    """A flat table, all of its columns or some. What ``parsed`` returned, as it is, is not written as JSON to be read again."""
    source = getattr(programs, "unparsed", None)
    if source is None:
        return flat(programs, partial(_of_program, make), ["program"], schema, columns)
    return flat(source, partial(_of_source, make), UNPARSED, schema, columns)


def program_units(programs: DataFrame) -> DataFrame:
    def make(p: dict) -> Iterator[dict]:
        for u, x in rows.units(p):
            yield {"unit": u} | {k: x[k] for k in ("program_id", "program_id_line", "has_procedure_division", "using", "returning", "notes", "nested_programs")}

    return _table(programs, make, "unit int, program_id string, program_id_line int, has_procedure_division boolean, using array<string>, returning string, notes array<string>, nested_programs array<string>")


def paragraphs(programs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return _table(programs, rows.paragraph_rows, "unit int, region string, para int, name string, line int, section string, is_section boolean, bare_name string, origin string, parse_error string, use_trigger string, use_files array<string>", columns)


def statements(programs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return _table(
        programs, partial(rows.statement_rows, with_attrs=columns is None or "attrs" in columns),
        "unit int, region string, para int, paragraph string, stmt_id int, parent_id int, branch string, condition string, ord int, path string, node string, line int, origin string, verb string, text string, attrs string",
        columns,
    )


def data_items(programs: DataFrame) -> DataFrame:
    return _table(
        programs, rows.item_rows,
        "unit int, item int, level int, name string, line int, origin string, section string, pic string, usage string, value string, file string, occurs int, "
        "occurs_depending string, redefines string, parent string, is_group boolean, sync boolean, sign_separate boolean, condition_values array<string>, "
        "condition_ranges array<array<string>>, cond_parent string, category string, digits int, scale int, signed boolean, spark_type string",
    )


def host_structures(programs: DataFrame) -> DataFrame:
    return _table(programs, rows.structure_rows, "unit int, group string, ord int, item string")


def exec_columns(programs: DataFrame) -> DataFrame:
    return _table(programs, rows.column_rows, "unit int, region string, para int, stmt_id int, slot int, column string, host_var string, derived boolean, expression string, derived_from array<string>")


def sql_tables(programs: DataFrame) -> DataFrame:
    return _table(programs, rows.table_rows, "unit int, region string, para int, stmt_id int, ord int, table string, verb string")


def sql_cursors(programs: DataFrame) -> DataFrame:
    return _table(programs, rows.cursor_rows, "unit int, cursor string, table string, tables array<string>, for_kind string, for_statement string, line int, columns array<string>")


def copybooks(programs: DataFrame) -> DataFrame:
    return _table(programs, rows.copybook_rows, "ord int, copy_member string, status string, via string, replacing boolean, line int, parent string, source string")


def needs(programs: DataFrame) -> DataFrame:
    """(member, kind, dependency, identity): a manifest of what each program depends on."""
    return _table(programs, rows.need_rows, "kind string, dependency string, identity string")


def assignments(programs: DataFrame) -> DataFrame:
    return _table(programs, rows.assignment_rows, "kind string, name string, value string, size int")


def dynamic_calls(programs: DataFrame) -> DataFrame:
    return _table(programs, rows.dynamic_call_rows, "unit int, para int, stmt_id int, name string, operand_limit int")


# ---- which program a call by a data item reaches


def not_a_name(literal: Column) -> Column:
    """Why a literal cannot be a program's name: space, wildcard, filler; null if it can."""
    filler = (F.length(literal) >= 4) & (F.replace(literal, F.substring(literal, 1, 1), F.lit("")) == "")
    return F.when((literal == "") | literal.rlike("(?U)\\s"), "space").when(literal.rlike("[*?]"), "wildcard").when(filler, "filler")


def resolve_calls(calls: DataFrame, facts: DataFrame) -> DataFrame:
    """A verdict for each (member, name, operand_limit) of ``calls`` from ``facts`` (see ``assignments``).

    Literals that reach the name over chains of assignments are its candidates;
    one alone, with no source left unknown and none rejected, is confident. The
    others say why not: ``mixed`` and ``variable-only`` depend on values at run
    time, ``declared-88`` knows condition values only.
    """
    facts = cut(facts, "call-facts")
    asks = calls.select("member", F.upper("name").alias("root"), "operand_limit").distinct()
    variables = facts.filter("kind = 'variable'")
    literals = facts.filter("kind = 'literal'").select("member", F.col("name").alias("node"), "value").distinct()
    edges = variables.filter("value IS NOT NULL").select("member", F.col("name").alias("src"), F.col("value").alias("dst")).distinct()
    reach = cut(reachable(asks.select("member", "root"), edges, ["member"]), "call-reach")
    # a chain is opaque where a source is no name, or a name beyond the first is assigned nothing at all
    known = facts.filter("kind IN ('literal', 'variable')").select("member", F.col("name").alias("node"), F.lit(True).alias("known")).distinct()
    strange = variables.filter("value IS NULL").select("member", F.col("name").alias("node"), F.lit(True).alias("strange")).distinct()
    ends = reach.join(known, ["member", "node"], "left").join(strange, ["member", "node"], "left")
    opaque = ends.groupBy("member", "root").agg(F.max(F.coalesce("strange", F.lit(False)) | ((F.col("depth") > 0) & F.col("known").isNull())).alias("opaque"))
    sizes = facts.filter("kind = 'size'").groupBy("member", F.col("name").alias("root")).agg(F.when(F.count_if(F.col("size").isNull()) == 0, F.max("size")).alias("size"))

    def admitted(values: DataFrame) -> DataFrame:
        """(member, root, operand_limit, names, rejected) of (member, root, value)."""
        each = asks.join(values.distinct(), ["member", "root"]).join(sizes, ["member", "root"], "left")
        bare = F.rtrim("value")
        passed = F.when(F.length(bare) > F.col("operand_limit"), F.rtrim(F.expr("substring(value, 1, operand_limit)"))).otherwise(F.col("value"))
        why = F.when(F.length(bare) > F.col("size"), "length").otherwise(not_a_name(F.rtrim(passed)))
        return each.groupBy("member", "root", "operand_limit").agg(
            F.sort_array(F.collect_set(F.when(why.isNull(), passed))).alias("names"),
            F.sort_array(F.collect_set(F.when(why.isNotNull(), F.struct(F.col("value").alias("literal"), why.alias("reason"))))).alias("rejected"),
        )

    same = F.expr("a.member = b.member AND a.root = b.root AND a.operand_limit <=> b.operand_limit")
    found = admitted(reach.join(literals, ["member", "node"]).select("member", "root", "value"))
    conditional = admitted(facts.filter("kind = 'condition'").select("member", F.col("name").alias("root"), "value"))
    out = asks.alias("a").join(found.alias("b"), same, "left").select("a.*", "names", "rejected")
    out = out.alias("a").join(conditional.alias("b"), same, "left").select("a.*", F.col("b.names").alias("names88"), F.col("b.rejected").alias("rejected88"))
    direct = variables.select("member", F.col("name").alias("root"), F.lit(True).alias("variable")).distinct()
    declared = facts.filter("kind = 'declared'").select("member", F.col("name").alias("root"), F.lit(True).alias("declared")).distinct()
    missing = facts.filter("kind = 'missing'").groupBy("member").agg(F.sort_array(F.collect_set("name")).alias("missing_copybooks"))
    out = out.join(opaque, ["member", "root"], "left").join(direct, ["member", "root"], "left").join(declared, ["member", "root"], "left").join(missing, "member", "left")
    nothing = F.array().cast("array<struct<literal:string,reason:string>>")
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) == 0
    none = F.array().cast("array<string>")
    # condition values count only where nothing else does
    own = F.coalesce("rejected", nothing)
    rejected = F.when(empty("names") & F.col("variable").isNull(), F.concat(own, F.coalesce("rejected88", nothing))).otherwise(own)
    out = out.withColumn("all_rejected", rejected)
    verdict = (
        F.when((F.size("names") == 1) & ~F.col("opaque") & empty("all_rejected"), "confident")
        .when(~empty("names") & ~F.col("opaque"), "candidates")
        .when(~empty("names"), "mixed")
        .when(F.col("variable"), "variable-only")
        .when(~empty("names88"), "declared-88")
        .when(~empty("all_rejected"), "rejected")
        .when(F.col("declared").isNull(), "undeclared")
        .otherwise("unassigned")
    )
    out = out.withColumn("verdict", verdict)
    candidates = F.when(F.col("verdict").isin("confident", "candidates", "mixed"), F.col("names")).when(F.col("verdict") == "declared-88", F.col("names88")).otherwise(none)
    return out.select(
        "member", F.col("root").alias("name"), "operand_limit", "verdict", (F.col("verdict") == "confident").alias("confident"),
        F.when(F.col("verdict") == "confident", F.get("names", 0)).alias("resolved"), candidates.alias("candidates"),
        F.col("verdict").isin("mixed", "variable-only").alias("has_variable_assignment"),
        F.when(F.col("verdict").isin("confident", "candidates", "mixed"), "assigned").when(F.col("verdict") == "declared-88", "declared-88").alias("evidence"),
        F.when(F.col("verdict") == "confident", nothing).otherwise(F.col("all_rejected")).alias("rejected"),
        F.when(F.col("verdict") == "undeclared", F.coalesce("missing_copybooks", none)).otherwise(none).alias("missing_copybooks"),
    )
