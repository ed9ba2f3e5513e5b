"""Joins and small expressions of the corpus operators, and the shared folder as they use it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources.shared import cut, delete, scratch, shared_dir, shared_path

__all__ = ["cut", "delete", "scratch", "shared_dir", "shared_path", "joined", "let", "looked_up", "with_spaces", "without", "words"]

#: ASCII white space: a word is a longest run of other characters.
SPACES = "\t\n\x0b\x0c\r "
#: A key with more rows than this and than its share of HOT_KEYS is looked up by broadcast.
HOT_ROWS, HOT_KEYS = 1 << 12, 1 << 16
#: Largest table, in bytes, that an operator broadcasts after measuring it.
BROADCAST_BYTES = 32 << 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def joined(left: DataFrame, right: DataFrame, on, how: str, right_bytes: int) -> DataFrame:
    """A join whose right side is broadcast only if its measured size is below ``BROADCAST_BYTES``; else AQE splits skewed keys."""
    return left.join(F.broadcast(right) if right_bytes <= BROADCAST_BYTES else right, on, how)


def looked_up(rows: DataFrame, found: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with ``found``, which has one row a ``key`` and in ``n`` how many rows have that key, ``total`` in all.

    A key of more than a ``HOT_KEYS``-th of the rows would be one task's work:
    those keys, at most ``HOT_KEYS``, are broadcast; the others are shuffled.
    """
    limit = max(HOT_ROWS, total // HOT_KEYS)
    if total <= limit:
        return rows.join(found.drop("n"), key)
    hot = F.broadcast(found.filter(F.col("n") > limit).drop("n"))
    cold = found.filter(F.col("n") <= limit).drop("n")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def with_spaces(text: Column) -> Column:
    """Every ASCII white-space character of ``text`` as a blank (byte replaces, no regex)."""
    for c in SPACES[:-1]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def words(text: Column) -> Column:
    """The words of ``text`` in order; none for null."""
    return F.array_remove(F.split(with_spaces(F.coalesce(text, F.lit(""))), " "), "")


def without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text
