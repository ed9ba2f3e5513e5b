"""Functions and table functions that SQL text can call after ``register``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from millrace.functions import cobol_text as ct
from millrace.functions import operands
from millrace.functions.cobol_data import pic_type, spark_type
from millrace.functions.cobol_sql import table_refs
from millrace.functions.shipping import ship

TOKEN = "tok_ix int, text string, up string, kind string, line int"
LINE = "ln_ix int, line int, text string, area_a boolean"
OPERAND = "ord int, keyword string, value string"
PICTURE = "category string, digits int, scale int, signed boolean, usage string, spark_type string"


class Tokens:
    """``cobol_tokens(text, fixed)``: a row a token of the code lines."""

    def eval(self, text: str, fixed: bool) -> Iterator[tuple]:
        for i, t in enumerate(ct.tokens(ct.logical_lines(text or "", bool(fixed)))):
            yield i, t.text, t.up, t.kind, t.line


class Lines:
    """``cobol_code_lines(text, fixed)``: a row a logical line."""

    def eval(self, text: str, fixed: bool) -> Iterator[tuple]:
        for i, x in enumerate(ct.logical_lines(text or "", bool(fixed))):
            yield i, x.line, x.text, x.area_a


class Operands:
    """``csd_operands(text)``: a row an operand of one definition's text."""

    def eval(self, text: str) -> Iterator[tuple]:
        found, _ = operands.definition_operands([(1, text or "")])
        for i, (keyword, value, _) in enumerate(found):
            yield i, keyword, value


class Tables:
    """``sql_tables(statement)``: a row a base table that an SQL statement names."""

    def eval(self, statement: str) -> Iterator[tuple]:
        for i, name in enumerate(table_refs(ct.mask_literals((statement or "").upper()))):
            yield i, name


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session: ``mask_literals(text)``, ``parse_pic(picture, usage)`` and the table functions above."""
    ship(spark)

    @F.pandas_udf("string")
    def mask_literals(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else ct.mask_literals(x))

    @F.pandas_udf(PICTURE)
    def parse_pic(pictures: pd.Series, usages: pd.Series) -> pd.DataFrame:
        kinds = [pic_type(p, u) for p, u in zip(pictures, usages, strict=True)]
        columns = [c.split()[0] for c in PICTURE.split(", ")]
        return pd.DataFrame([[*(k[c] for c in columns[:-1]), spark_type(k)] for k in kinds], columns=columns)

    spark.udf.register("mask_literals", mask_literals)
    spark.udf.register("parse_pic", parse_pic)
    for name, made, schema in (("cobol_tokens", Tokens, TOKEN), ("cobol_code_lines", Lines, LINE), ("csd_operands", Operands, OPERAND), ("sql_tables", Tables, "ord int, name string")):
        spark.udtf.register(name, F.udtf(made, returnType=schema))
