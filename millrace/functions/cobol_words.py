"""A piece of COBOL text as words, with a cursor: what clauses are read with instead of patterns.

A piece is a quoted literal or a run without blanks, commas, semicolons and
quotes; a period ends a run only at its end, so pictures and decimals stay
whole. Clauses are found by their words wherever they stand.
"""

from __future__ import annotations

import re

PIECE = re.compile(r"""'[^']*'|"[^"]*"|[^\s,;'"]+|['"]""")
PLAIN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-")


def is_name(word: str) -> bool:
    """Whether a word can name a data item, a paragraph or a program."""
    return bool(word) and word[0] != "-" and PLAIN.issuperset(word.upper())


def headed(text: str, *phrase: str) -> bool:
    """Whether a line has these words one after another, whatever periods are around them."""
    return phrase[0] in text.upper() and Words(text.replace(".", " ")).phrase(*phrase) is not None


class Words:
    """The pieces of a text: ``raw`` as written, ``up`` in upper case without periods at the end, '' for a literal."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.raw: list[str] = []
        self.spans: list[tuple[int, int]] = []
        self.ends: list[bool] = []  # whether a period follows
        for m in PIECE.finditer(text):
            if m[0].strip("."):
                self.raw.append(m[0])
                self.spans.append(m.span())
                self.ends.append(m[0][-1] == "." and m[0][0] not in "'\"")
            elif self.ends:
                self.ends[-1] = True
        self.up = ["" if x[0] in "'\"" else x.rstrip(".").upper() for x in self.raw]

    def __len__(self) -> int:
        return len(self.raw)

    def word(self, i: int) -> str:
        return self.up[i] if 0 <= i < len(self.up) else ""

    def seek(self, *words: str, start: int = 0) -> int | None:
        """The place behind the first of ``words`` from ``start`` on."""
        return next((i + 1 for i in range(start, len(self.up)) if self.up[i] in words), None)

    def over(self, i: int, *noise: str) -> int:
        """The first place from i on that is none of the ``noise`` words."""
        while self.word(i) in noise:
            i += 1
        return i

    def name(self, i: int | None) -> str | None:
        """The name at a place."""
        return self.up[i] if i is not None and i < len(self.up) and is_name(self.up[i]) else None

    def phrase(self, *words: str, start: int = 0) -> int | None:
        """The place behind the first spot where ``words`` follow each other."""
        n = len(words)
        return next((i + n for i in range(start, len(self.up) - n + 1) if tuple(self.up[i : i + n]) == words), None)

    def rest(self, i: int) -> str:
        """The text behind the piece before place i."""
        return self.text[self.spans[i - 1][1] :] if i else self.text
