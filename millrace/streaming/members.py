"""Members as they arrive in a folder.

Lexing and parsing are per member and keep no state, so a stream of whole
files needs no watermark: each file is read once, as a whole, and gives its
rows in the batch that found it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.members import decoded, member_key

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_members(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """(member, source_name, text, source) of every file that appears below ``path``."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(path)
    name = F.regexp_extract("path", "([^/\\\\]+)$", 1)
    return files.select(member_key(F.regexp_replace(name, "\\.[^.]*$", "")).alias("member"), name.alias("source_name"), decoded(F.col("content")).alias("text"), F.col("path").alias("source"))
