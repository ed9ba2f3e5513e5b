"""``python -m millrace.cli SOURCES -o DIR``: parse bundles of COBOL members, with copybooks from folders, a service or recorded answers.

Exit status: 0 done, 1 a member could not be read or written, 2 wrong
arguments, 130 interrupted.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.timing import StageTimer, configure_logging, log
from millrace.operators import cobol, estate, retrieval
from millrace.sources.maps import read_answers, read_synonyms, write_answers
from millrace.sources.members import read_members


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="millrace", description=__doc__)
    p.add_argument("sources", nargs="+", help="files or folders of COBOL members")
    p.add_argument("-o", "--output", required=True, help="folder for the bundles, written as Parquet (member, bundle)")
    p.add_argument("-I", "--copy", action="append", default=[], metavar="DIR", help="folder of copybooks; earlier ones win")
    p.add_argument("--format", choices=("auto", "fixed", "free"), default="auto")
    asked = p.add_argument_group("retrieval", "copybooks that no folder has")
    asked.add_argument("--fetcher", metavar="MODULE:FUNC", help="function (name, type=, copy=) that returns a member, or None")
    asked.add_argument("--jobs", type=int, default=8, help="requests at a time, at least 1")
    asked.add_argument("--gather-only", metavar="DIR", help="only retrieve, and record every answer in DIR")
    asked.add_argument("--from-bundle", metavar="DIR", help="take the answers recorded in DIR instead of asking")
    asked.add_argument("--no-fetch", action="store_true", help="ask nobody")
    names = p.add_argument_group("synonyms", "the tables that SQL names, with the base tables of synonyms, are written to DIR.tables")
    names.add_argument("--synonym-map", metavar="FILE", help="JSON object of synonym and base table")
    names.add_argument("--synonym-resolver", metavar="MODULE:FUNC", help="function (name) that returns a base table, or None; asked what the map lacks")
    p.add_argument("--timing", action="store_true")
    p.add_argument("-v", "--verbose", action="count", default=0)
    p.add_argument("-q", "--quiet", action="store_true")
    return p


def library(spark: SparkSession, folders: list[str]) -> DataFrame | None:
    """The copybooks of all folders, the first folder's first."""
    ranked = [read_members(spark, d).select("member", "text", "source").withColumn("rank", F.lit(i)) for i, d in enumerate(folders)]
    return cobol.ranked_library(reduce(DataFrame.unionByName, ranked), ["rank"]) if ranked else None


class WrongArgument(ValueError):
    """An input that was named and cannot be used."""


def function(spec: str) -> Callable:
    found, why = retrieval.loaded(spec)
    if found is None:
        raise WrongArgument(why)
    return found


def asker(spark: SparkSession, args: argparse.Namespace) -> Callable[[DataFrame], DataFrame] | None:
    """What answers requests: recorded answers, the service, or nothing."""
    if args.no_fetch:
        return None
    if args.from_bundle:
        recorded = read_answers(spark, args.from_bundle)
        blank = [F.lit(None).cast("string").alias(c) for c in ("detected_type", "error")]
        return lambda asks: estate.replayed(asks, recorded).select("*", *blank)
    if not args.fetcher:
        return None
    service = function(args.fetcher)
    for keyword in retrieval.advice(service):
        log.warning("%s takes no %s=; it is asked without", args.fetcher, keyword)
    return lambda asks: retrieval.ask_service(asks, service, max(1, args.jobs))


def completed(spark: SparkSession, members: DataFrame, own: DataFrame | None, ask: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(retrieved, library): what came of asking for all copybooks that the folders lack, and the folders' and retrieved members together."""
    own = own if own is not None else spark.createDataFrame([], "member string, text string, source string")
    start = cobol.copy_edges(members).select(F.col("copy_member").alias("member"))
    found = retrieval.closed(start, own, cobol.copy_edges, ask)
    for row in estate.status_counts(found).collect():
        log.info("copybooks %s: %d", row["status"], row["n"])
    return found, own.unionByName(found.filter("status = 'fetched'").select("member", "text", "source"))


def table_names(spark: SparkSession, programs: DataFrame, args: argparse.Namespace) -> DataFrame:
    """(member, table, base, door) of the tables that embedded SQL names."""
    tables = cobol.sql_tables(programs).select("member", F.upper("table").alias("table")).distinct()
    known = read_synonyms(spark, args.synonym_map) if args.synonym_map else spark.createDataFrame([], "name string, base string")
    names = tables.select(F.col("table").alias("name"))
    if args.synonym_resolver:
        found = retrieval.resolved(names, known, function(args.synonym_resolver), max(1, args.jobs))
    else:
        found = estate.synonyms(names.distinct(), known)
    return tables.join(found.select(F.col("name").alias("table"), "base", "door"), "table", "left")


def main(argv: list[str] | None = None) -> int:
    try:
        args = arguments().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    configure_logging(args.verbose, args.quiet)
    timer = StageTimer(args.timing)
    try:
        spark = SparkSession.builder.appName("millrace").getOrCreate()
        with timer.stage("read"):
            members = reduce(DataFrame.unionByName, [read_members(spark, s, "program") for s in args.sources])
            if args.format != "auto":
                members = members.withColumn("format", F.lit(args.format))
            detected = cobol.format_detection(members).filter("confidence < 0.6").select("member").limit(20).collect() if args.format == "auto" else []
            for row in detected:
                log.warning("%s: the source format is a guess", row["member"])
        books, errors, ask = library(spark, args.copy), None, asker(spark, args)
        if ask is not None:
            with timer.stage("retrieve"):
                found, books = completed(spark, members, books, ask)
                errors = found.filter("status = 'error'").select("member", "error")
            if args.gather_only:
                outcome = F.when(F.col("status") == "fetched", "found").otherwise(F.col("status")).alias("outcome")
                blank = F.lit(None).cast("string").alias("detected_type")
                asked = found.filter("status NOT IN ('local', 'skipped')").select(F.xxhash64("member").alias("seq"), F.col("member").alias("name"), F.lit("copybook").alias("asked_type"), outcome, "text", "source", blank, "error")
                write_answers(asked, args.gather_only)
                return 0
        with timer.stage("parse and write"):
            programs = cobol.parsed(members, books, errors)
            cobol.bundles(programs).write.mode("overwrite").parquet(args.output)
            if args.synonym_map or args.synonym_resolver:
                table_names(spark, programs, args).write.mode("overwrite").parquet(args.output.rstrip("/") + ".tables")
    except WrongArgument as e:
        log.error("%s", e)
        return 2
    except KeyboardInterrupt:
        return 130
    except Exception as e:  # noqa: BLE001 - the status says it, the message why
        log.error("%s: %s", type(e).__name__, e)
        return 1
    timer.report()
    return 0


if __name__ == "__main__":
    sys.exit(main())
