"""Operand lists of CICS definitions: pure functions over one statement's text."""

from __future__ import annotations

import re
from bisect import bisect_right

NAME = re.compile(r"[A-Za-z0-9$#@_.\-]+")
PAREN = re.compile(r"[()]")


def closing(text: str, opened: int) -> int:
    """Where the parenthesis at ``opened`` closes; -1 if it does not."""
    depth = 0
    for m in PAREN.finditer(text, opened):
        depth += 1 if m[0] == "(" else -1
        if not depth:
            return m.start()
    return -1


def line_of(starts: list[int], lines: list[int], offset: int) -> int:
    """The line of the last chunk that begins at or before ``offset``."""
    return lines[max(0, bisect_right(starts, offset) - 1)] if lines else 0


def joined(chunks: list[tuple[int, str]], separator: str) -> tuple[str, list[int], list[int]]:
    """Chunks (line, text) as one text, with each chunk's offset and line."""
    starts, at = [], 0
    for _, text in chunks:
        starts.append(at)
        at += len(text) + len(separator)
    return separator.join(t for _, t in chunks), starts, [n for n, _ in chunks]


def definition_operands(chunks: list[tuple[int, str]]) -> tuple[list[tuple[str, str | None, int]], list[tuple[str, int]]]:
    """((keyword, value, line)..., (keyword, line) of values that never close) of a definition.

    A keyword without parentheses has the value None; a value that never
    closes is the rest of the statement.
    """
    text, starts, lines = joined(chunks, " ")
    found: list[tuple[str, str | None, int]] = []
    open_: list[tuple[str, int]] = []
    at = 0
    while m := NAME.search(text, at):
        keyword, line = m[0].upper(), line_of(starts, lines, m.start())
        at = m.end()
        if not text.startswith("(", at):
            found.append((keyword, None, line))
            continue
        end = closing(text, at)
        found.append((keyword, (text[at + 1 :] if end < 0 else text[at + 1 : end]).strip(), line))
        if end < 0:
            open_.append((keyword, line))
            break
        at = end + 1
    return found, open_


def macro_operands(text: str) -> list[tuple[str | None, str]]:
    """(keyword or None, value) of an assembler operand field: it ends at the first blank outside quotes and parentheses."""
    parts, begin, depth, quoted = [], 0, 0, False
    end = len(text)
    for i, ch in enumerate(text):
        if ch == "'":
            quoted = not quoted
        elif quoted:
            continue
        elif ch in "()":
            depth += 1 if ch == "(" else -1
        elif depth == 0 and ch == ",":
            parts.append(text[begin:i])
            begin = i + 1
        elif depth == 0 and ch == " ":
            end = i
            break
    parts.append(text[begin:end])
    out: list[tuple[str | None, str]] = []
    for part in filter(None, (p.strip() for p in parts)):
        name, sign, value = part.partition("=")
        named = bool(sign) and name.strip().replace("&", "").isidentifier()
        out.append((name.strip().upper(), value.strip()) if named else (None, part))
    return out
