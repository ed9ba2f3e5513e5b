"""JSON maps and recorded answers as tables, refused as a whole where they are malformed.

A map is read as one text; what is wrong with it is an error with the reason,
because half a map would answer "not there" for what it merely lacks.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.estate import manifest_kind
from millrace.sources.members import member_key

ANSWER = "seq long, name string, asked_type string, outcome string, text string, source string, detected_type string, error string"


class MapError(ValueError):
    """A map that is not read."""


def _document(spark: SparkSession, path: str) -> dict:
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise MapError(f"{path} is not one file")
    try:
        doc = json.loads(rows[0][0])
    except ValueError as e:
        raise MapError(f"{path} is not valid JSON: {e}") from None
    if not isinstance(doc, dict):
        raise MapError(f"{path} must be a JSON object")
    return doc


def read_synonyms(spark: SparkSession, path: str) -> DataFrame:
    """(name, base) of a flat JSON object of strings."""
    doc = _document(spark, path)
    if not all(isinstance(v, str) for v in doc.values()):
        raise MapError(f"{path}: every value must be the name of a table")
    return spark.createDataFrame(list(doc.items()), "name string, base string").select(F.upper("name").alias("name"), F.upper("base").alias("base"))


def read_dependents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(coverage, edges) of a JSON object "NAME|KIND" -> rows; an empty list is a statement and stays in the coverage."""
    doc = _document(spark, path)
    covered, edges = [], []
    for key, rows in doc.items():
        if not key.strip() or not isinstance(rows, list):
            raise MapError(f"{path}: {key!r} must name a list of rows")
        name, _, kind = key.partition("|")
        covered.append((name, kind.strip() or None))
        for row in rows:
            if not isinstance(row, dict) or not str(row.get("name") or "").strip():
                raise MapError(f"{path}: {key!r} has a row without a name")
            edges.append((name, kind.strip() or None, *(None if row.get(c) is None else str(row[c]) for c in ("name", "kind", "via", "match_strength", "detail"))))
    frame = spark.createDataFrame(edges, "of_name string, of_kind string, name string, kind string, via string, match_strength string, detail string")
    unknown = frame.filter(manifest_kind(F.col("kind")).isNull()).limit(1).collect()
    if unknown:
        raise MapError(f"{path}: {unknown[0]['of_name']} has a row of kind {unknown[0]['kind']!r}, which is not known")
    return spark.createDataFrame(covered, "name string, kind string"), frame


def write_answers(answers: DataFrame, path: str) -> None:
    """Records what a service answered, in the order of the asks, so that a later run can do without the service."""
    columns = [c.split()[0] for c in ANSWER.split(", ")]
    answers.select(*columns).repartitionByRange(F.col("seq")).sortWithinPartitions("seq").write.mode("errorifexists").parquet(path)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(ANSWER).parquet(path)
    return rows.withColumn("name", member_key(F.col("name")))


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line, nulls left out."""
    rows.write.mode("errorifexists").json(path)
