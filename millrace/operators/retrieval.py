"""Asking an estate's services: members, synonyms and dependents, once each, and copies until nothing is missing.

A service is a Python function. It is called once a request: its answers are
written to the shared folder before anything reads them, so later actions and
retried tasks see the same answers. What a service raises or returns is a fact
of that one request, never an end of the run.
"""

from __future__ import annotations

import importlib
import inspect
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.shipping import ship
from millrace.operators.estate import MATCH_STRENGTHS, MEMBER_NAME
from millrace.sources.members import member_key
from millrace.sources.shared import cut

#: The keys under which a mapping holds a text, or says where it is from.
TEXT_KEYS = ("text", "content", "data", "body")
SOURCE_KEYS = ("source_location", "source_path", "source", "path", "file")
ANSWERED = {"seq": "long"} | dict.fromkeys(("name", "asked_type", "outcome", "text", "source", "detected_type", "error"), "string")
EDGE_FIELDS = ("name", "kind", "via", "match_strength", "detail")
EDGES = "array<struct<name:string,kind:string,via:string,match_strength:string,detail:string>>"


# ---- services as functions


def loaded(spec: str | None) -> tuple[Callable | None, str | None]:
    """(function, None) of ``module:function``, or (None, why not): a service that is not there is no error of the run."""
    module, _, name = (spec or "").partition(":")
    if not module.strip() or not name.strip():
        return None, f"{spec!r} is not of the form module:function"
    try:
        found = getattr(importlib.import_module(module.strip()), name.strip(), None)
    except Exception as e:  # noqa: BLE001 - whatever the import raises is the reason
        return None, f"{module} cannot be imported: {type(e).__name__}: {e}"
    return (found, None) if callable(found) else (None, f"{module} has no function {name}")


def advice(service: Callable, keywords: tuple[str, ...] = ("type", "copy")) -> list[str]:
    """The keywords that a service does not take, as its signature says; nothing where it cannot be read. Calls do without them."""
    try:
        parameters = inspect.signature(service).parameters.values()
    except (TypeError, ValueError):
        return []
    if any(p.kind is p.VAR_KEYWORD for p in parameters):
        return []
    return [k for k in keywords if not any(p.name == k and p.kind is not p.POSITIONAL_ONLY for p in parameters)]


def called(service: Callable, name: str, **said) -> object:
    """What the service returns for a name; keywords that it refuses are left out, the last first, then passed by place."""
    said = {k: v for k, v in said.items() if v is not None}
    tries = [dict(list(said.items())[:n]) for n in range(len(said), 0, -1)]
    for keywords in tries:
        try:
            return service(name, **keywords)
        except TypeError:
            continue
    try:
        return service(name)
    except TypeError:
        return service(name, *(list(said.values())[:1] or [None]))


def decoded(raw: bytes) -> str:
    try:
        return bytes(raw).decode()
    except UnicodeDecodeError:
        return bytes(raw).decode("latin-1")


def answer(got: object, name: str) -> tuple[str, str | None, str | None, str | None]:
    """(outcome, text, source, detected type) of what a service returned.

    Nothing is None, False, an empty sequence, a mapping that says it is not
    found or has no text, and blank text. A member is a text, bytes, a path of a
    file, a (text, source) pair or a mapping. Any other shape raises TypeError.
    """
    detected, source = None, name
    if isinstance(got, os.PathLike):
        source = os.fspath(got)
        if not os.path.isfile(source):
            return "not-found", None, None, None
        with open(source, "rb") as f:
            got = f.read()
    elif isinstance(got, dict):
        detected = got.get("detected_type") or got.get("type")
        source = next((got[k] for k in SOURCE_KEYS if got.get(k)), name)
        got = None if got.get("found") is False else next((got[k] for k in TEXT_KEYS if got.get(k) is not None), None)
    elif isinstance(got, (tuple, list)):
        source = got[1] if len(got) > 1 and got[1] else name
        got = got[0] if got else None
    if got is None or got is False:
        return "not-found", None, None, None
    text = decoded(got) if isinstance(got, (bytes, bytearray)) else got
    if not isinstance(text, str):
        raise TypeError(f"{type(got).__name__} is no member")
    return ("found", text, str(source), detected) if text.strip() else ("not-found", None, None, None)


def mapped(asks: DataFrame, make: Callable[[tuple], tuple], schema: dict[str, str], jobs: int, name: str) -> DataFrame:
    """Rows ``make(row)`` of ``asks``, a row at a time in ``jobs`` tasks, written once."""
    ship(asks.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [make(tuple(None if pd.isna(x) else x for x in row)) for row in batch.itertuples(index=False, name=None)]
            yield pd.DataFrame(rows, columns=list(schema))

    made = asks.repartition(max(1, jobs)).mapInPandas(run, ", ".join(f"{k} {v}" for k, v in schema.items()))
    return cut(made, name)


def ask_service(asks: DataFrame, service: Callable, jobs: int = 8, copy_to: str | None = None) -> DataFrame:
    """(seq, name, asked_type, outcome, text, source, detected_type, error) of each of ``asks`` (seq, name, asked_type), in their order."""

    def make(row: tuple) -> tuple:
        seq, name, kind = row
        try:
            return seq, name, kind, *answer(called(service, name, type=kind, copy=copy_to), name), None
        except Exception as e:  # noqa: BLE001 - one failed request is one row
            return seq, name, kind, "error", None, None, None, f"{type(e).__name__}: {e}"

    rows = asks.select(F.col("seq").cast("long"), "name", "asked_type")
    return mapped(rows, make, ANSWERED, jobs, "answers").orderBy("seq")


# ---- until nothing is missing


def closed(start: DataFrame, local: DataFrame, copies: Callable[[DataFrame], DataFrame], ask: Callable[[DataFrame], DataFrame] | None, asked_type: str = "copybook", levels: int = 100) -> DataFrame:
    """(member, level, status, source, text, error): members that ``start`` (member) needs, and what they need, and so on.

    A level is all that the level before names and no earlier one had: it is
    looked up in ``local`` (member, text, source), the rest is asked for at once
    through ``ask`` (see ``ask_service``; null: no service), and what came is
    read by ``copies`` ((member, text) to (member, copy_member)) for the next.
    Statuses are local, fetched, not-found, error, no-service and skipped (no
    member name). Each level is written before the next begins.
    """
    spark = start.sparkSession
    known = local.groupBy(member_key(F.col("member")).alias("member")).agg(F.min(F.struct("source", "text")).alias("own"))
    wave = cut(start.select(member_key(F.col("member")).alias("member")).distinct(), "wave")
    done, seen = None, wave
    for level in range(levels):
        if wave.isEmpty():
            break
        rows = wave.join(known, "member", "left").withColumn("good", F.col("member").rlike(MEMBER_NAME))
        asked = rows.filter("own IS NULL AND good").select(F.xxhash64("member").alias("seq"), F.col("member").alias("name"), F.lit(asked_type).alias("asked_type"))
        if ask is None:
            answers = spark.createDataFrame([], ", ".join(f"{k} {v}" for k, v in ANSWERED.items()))
        else:
            answers = ask(asked)
        got = answers.select(F.col("name").alias("member"), "outcome", F.struct("source", "text").alias("their"), "error")
        status = (
            F.when(F.col("own").isNotNull(), "local").when(~F.col("good"), "skipped").when(F.col("outcome") == "found", "fetched")
            .when(F.col("outcome").isNotNull(), F.col("outcome")).otherwise("no-service")
        )
        held = F.coalesce("own", F.when(F.col("outcome") == "found", F.col("their")))
        out = rows.join(got, "member", "left").select("member", F.lit(level).alias("level"), status.alias("status"), held["source"].alias("source"), held["text"].alias("text"), "error")
        out = cut(out, "retrieved")
        done = out if done is None else done.unionByName(out)
        named = copies(out.filter("text IS NOT NULL").select("member", "text")).select(member_key(F.col("copy_member")).alias("member")).distinct()
        wave = cut(named.join(seen, "member", "left_anti"), "wave")
        seen = seen.unionByName(wave)
    return done if done is not None else spark.createDataFrame([], "member string, level int, status string, source string, text string, error string")


def report(rows: DataFrame) -> DataFrame:
    """(status, n, missing): how many requests ended how, and the names of those that ended without a text.

    ``rows`` is (member, asked_type, status). A name stands with its type only
    if it was asked for under several types. A list is as long as its status has rows.
    """
    types = rows.groupBy("member").agg(F.count_distinct("asked_type").alias("types"))
    shown = F.when(F.col("types") > 1, F.concat("member", F.lit(" ("), "asked_type", F.lit(")"))).otherwise(F.col("member"))
    lacks = F.col("status").isin("not-found", "error", "no-service")
    each = rows.join(types, "member").select("status", F.when(lacks, shown).alias("shown"))
    return each.groupBy("status").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("shown")).alias("missing"))


# ---- lookups through a function


class Resolver:
    """A lookup that is asked once a name and no more after it misbehaved: it raised, or returned what is no name."""

    def __init__(self, service: Callable) -> None:
        self.service, self.memo, self.disabled = service, {}, None

    def __call__(self, name: str) -> tuple[str | None, str | None]:
        """(base or None, why there is no answer or None)."""
        if self.disabled is None and name not in self.memo:
            try:
                got = self.service(name)
            except Exception as e:  # noqa: BLE001 - raising is the failure
                self.disabled = f"{type(e).__name__}: {e}"
            else:
                if got is not None and not (isinstance(got, str) and got.strip()):
                    self.disabled = f"{name} was answered by {type(got).__name__} {got!r}, which is no name"
                else:
                    self.memo[name] = got and got.strip().upper()
        return (self.memo[name], None) if name in self.memo else (None, self.disabled)


def resolved(names: DataFrame, mapping: DataFrame, service: Callable, jobs: int = 1) -> DataFrame:
    """(name, base, door, reason) of ``names`` (name): by the map (name, base), else by the service, each different name once.

    A task whose service misbehaved asks it no more: the names left have the
    ``reason`` and no base, which is not the same as being no synonym.
    """
    asked = names.select(F.upper("name").alias("name")).distinct()
    known = mapping.groupBy(F.upper("name").alias("name")).agg(F.min(F.upper("base")).alias("mapped"))
    rest = asked.join(known, "name", "left_anti").orderBy("name")
    resolver = Resolver(service)
    found = mapped(rest, lambda row: (row[0], *resolver(row[0])), dict.fromkeys(("name", "base", "reason"), "string"), jobs, "resolved")
    rows = asked.join(known, "name", "left").join(found, "name", "left")
    door = F.when(F.col("mapped").isNotNull(), "map").when(F.col("base").isNotNull(), "resolver")
    return rows.select("name", F.coalesce("mapped", "base").alias("base"), door.alias("door"), "reason")


def edge(row: object) -> tuple:
    """The fields of one dependent; raises ValueError where it is none."""
    if isinstance(row, str):
        row = {"name": row}
    if not isinstance(row, dict) or not str(row.get("name") or "").strip():
        raise ValueError("a row without a name")
    if row.get("match_strength") not in (None, *MATCH_STRENGTHS):
        raise ValueError(f"match strength {row['match_strength']!r}")
    return tuple(None if row.get(c) is None else str(row[c]).strip() for c in EDGE_FIELDS)


def ask_dependents(asks: DataFrame, service: Callable, jobs: int = 8) -> DataFrame:
    """(seq, name, kind, outcome, rows, error) of each of ``asks`` (seq, name, kind): answered, not-covered (None), unreadable or error."""

    def make(row: tuple) -> tuple:
        seq, name, kind = row
        try:
            got = called(service, name, kind=kind)
        except Exception as e:  # noqa: BLE001 - one failed request is one row
            return seq, name, kind, "error", None, f"{type(e).__name__}: {e}"
        if got is None:
            return seq, name, kind, "not-covered", None, None
        try:
            got = got.get("rows") if isinstance(got, dict) else got
            return seq, name, kind, "answered", [dict(zip(EDGE_FIELDS, edge(x), strict=True)) for x in got], None
        except (TypeError, ValueError) as e:
            return seq, name, kind, "unreadable", None, str(e)

    rows = asks.select(F.col("seq").cast("long"), "name", "kind")
    return mapped(rows, make, {"seq": "long", "name": "string", "kind": "string", "outcome": "string", "rows": EDGES, "error": "string"}, jobs, "dependents").orderBy("seq")


def recorded(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(coverage, edges) for ``estate.dependents`` of what was answered: an answer without rows is covered, the other outcomes are not."""
    good = answers.filter("outcome = 'answered'")
    edges = good.select(F.col("name").alias("of_name"), F.col("kind").alias("of_kind"), F.explode("rows").alias("x")).select("of_name", "of_kind", "x.*")
    return good.select("name", "kind").distinct(), edges
