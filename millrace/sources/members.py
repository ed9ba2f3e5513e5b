"""Members: named source texts, read whole, and their lines.

A member is a row (member, text) and possibly others; its name is trimmed,
unquoted and upper case. All of this is column expressions: a member's lines
are an array of its own row, so nothing here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Source text that one reading or parsing task takes: seconds of Python, and what a worker holds at a time.
WORK_BYTES = 4 << 20
#: Where COBOL text breaks, and where definition decks do (all that Unicode calls a line boundary).
COBOL_BREAK = "\r\n|\r|\n"
DECK_BREAK = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\u0085\u2028\u2029]"


def member_key(name: Column) -> Column:
    """A member's identity: without blanks around it, then without quotes around it, upper case."""
    return F.upper(F.btrim(F.trim(name), F.lit("'\"")))


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 where they are that, else Latin-1, which never fails."""
    as_text = content.cast("string")
    return F.when(F.is_valid_utf8(as_text), as_text).otherwise(F.decode(content, "ISO-8859-1"))


def read_members(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """(member, kind, source_name, text, source, sha256) of the files under ``path``; the member is the file's stem."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", "([^/\\\\]+)$", 1)
    text = decoded(F.col("content"))
    return files.select(
        member_key(F.regexp_replace(name, "\\.[^.]*$", "")).alias("member"), F.lit(kind).alias("kind"), name.alias("source_name"),
        text.alias("text"), F.col("path").alias("source"), F.sha2(text.cast("binary"), 256).alias("sha256"),
    )


def cobol_lines(text: Column) -> Column:
    """Lines as an array; a final line end leaves an empty last line."""
    return F.split(text, COBOL_BREAK)


def deck_lines(text: Column) -> Column:
    """Lines as an array; a final line end leaves none behind."""
    lines = F.split(text, DECK_BREAK)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def by_work(rows: DataFrame) -> DataFrame:
    """``rows`` (member, text and others) dealt by the text to read: left to the session, small rows of much work share few tasks."""
    if rows.isStreaming:  # a batch's size is not known beforehand
        return rows
    n, total = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    tasks = max(-(-(total or 0) // WORK_BYTES), min(n, 2 * rows.sparkSession.sparkContext.defaultParallelism), 1)
    return rows.repartition(tasks, "member")


def canonical_type(name: Column) -> Column:
    """The one spelling of a member type; unknown ones are only trimmed and lower case, blank ones null."""
    low = F.lower(F.trim(name))
    found = F.create_map([F.lit(x) for pair in TYPE_NAMES.items() for x in pair])
    return F.when(low != "", F.coalesce(found[low], low))


#: Other names of member types.
TYPE_NAMES = {
    "assembler": "asm", "hlasm": "asm", "alc": "asm", "bal": "asm",
    "cob": "cobol", "cbl": "cobol",
    "pl1": "pli", "pl/1": "pli", "pl/i": "pli",
}


def looks_like_jcl(source_name: Column, text: Column) -> Column:
    """By its suffix, or because the first line that is no comment is a JOB or PROC statement."""
    lines = F.filter(F.transform(deck_lines(text), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("//*"))
    suffix = F.element_at(F.split(F.lower(source_name), "\\."), -1).isin("jcl", "prc", "proc")
    return suffix | F.coalesce(F.get(lines, 0).rlike("(?i)^//\\S*\\s+(JOB|PROC)\\b"), F.lit(False))


#: File endings by type of member.
ENDINGS = {
    "cobol": ".cbl", "copybook": ".cpy", "ddl": ".sql", "cntl": ".txt", "bms": ".bms", "csd": ".txt", "jcl": ".jcl", "proc": ".prc", "asm": ".asm",
    "pli": ".pli", "c": ".c", "macro": ".mac", "easytrieve": ".ezt",
}


def saved_name(member: Column, kind: Column) -> Column:
    """The file name under which a member of a type is kept: what is unsafe in a name becomes an underscore."""
    ending = F.create_map([F.lit(x) for pair in ENDINGS.items() for x in pair])[canonical_type(kind)]
    return F.concat(F.regexp_replace(member, "(?U)[^\\p{Alnum}$#@._-]", "_"), F.coalesce(ending, F.lit(".txt")))


def type_disagreement(asked: Column, detected: Column) -> Column:
    """Whether a member was asked for as one type and reported as another; null where either is unknown."""
    return canonical_type(asked) != canonical_type(detected)


def external_statements(spark: SparkSession, path: str, rendered: DataFrame) -> DataFrame:
    """(member, line, kind) of the statements in an external parser's XML trees.

    ``rendered`` is (source, rendered_line, member, line): which physical line
    of which member stands on each line of the text that was parsed; ``source``
    is the tree's file stem.
    """
    schema = "`_from-line` int, `_kind` string"
    trees = spark.read.format("xml").option("rowTag", "statement").schema(schema).load(path)
    trees = trees.select(F.regexp_extract("_metadata.file_name", "^(.*?)\\.[^.]*$", 1).alias("source"), F.col("`_from-line`").alias("rendered_line"), F.col("_kind").alias("kind"))
    return trees.filter("rendered_line IS NOT NULL").join(rendered, ["source", "rendered_line"]).select("member", "line", "kind")
