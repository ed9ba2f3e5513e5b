"""BPE encoding and decoding by dynamic programming over prefixes.

For byte pair merges with one merge per token, every prefix of a word has one
last token: of the tokens that end there, the one that may follow the last
token of what is before it. The tokens that end at a place are read off a
suffix automaton of the vocabulary: its state says the longest suffix of the
prefix that is part of any token, and the tokens on the path of suffix links
are those that end there. Whether a token may follow another is decided by
undoing merges on both sides of their border until either a merge across it
would have come first (no) or nothing is left to undo (yes). Following the last
tokens back from the end of a word gives its ids. A group of texts is cut into
words first, and each distinct word of it is solved once.

The vocabulary file is a parameter and is read on each worker. It describes a
word-end BPE: NFC, white space as word border, lower case by character, words
cut by a pattern, bytes as printable characters, and a mark at the last one.

Cases with a defined result: null and empty texts have no tokens and decode to
the empty string; special tokens found in a text become their ids; texts are
taken whole, a very long one in parts that end at white space; repeated rows
each get their row; other columns are not read, or are carried along by
``encode``.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import cache, partial
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.shipping import give_back, map_arrow

#: Words whose ids a worker remembers from one group of texts to the next.
MEMO = 120_000
#: Characters of text whose words are in memory at a time.
GROUP = 2_000_000
WORD_END = "</w>"
#: Words of more bytes are solved one by one, as few others are as long.
LONG = 64
#: Slots of the table of solved pairs.
PAIR_SLOTS = 1 << 19
#: Rows that go through the coder at a time.
ROWS = 1024
#: Added to the last byte of a word: the symbol that carries the mark.
LAST = 256
#: What the file's pattern calls white space.
SPACE = "\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
FIRST_UNUSUAL = 0x250


def byte_characters() -> list[str]:
    """The printable character that stands for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


def characters(category: str, limit: int) -> str:
    """The characters below ``limit`` of a general category, escaped for a character class."""
    return "".join(re.escape(chr(c)) for c in range(limit) if unicodedata.category(chr(c))[0] == category)


class SuffixAutomaton:
    """The smallest automaton of all parts of the given sequences of symbols below 512.

    ``step`` maps state << 9 | symbol to the next state; ``longest`` is the
    length of a state's longest part, ``link`` the state of the longest suffix
    with other endings. A whole sequence is the longest part of its state, as
    nothing longer ends where it ends.
    """

    def __init__(self, sequences: Iterable[list[int]]) -> None:
        self.step: dict[int, int] = {}
        self.longest, self.link, self.out = [0], [-1], [[]]
        self.final = [self.add(x) for x in sequences]
        del self.out

    def state(self, longest: int, link: int, out: list[int]) -> int:
        self.longest.append(longest)
        self.link.append(link)
        self.out.append(out)
        return len(self.longest) - 1

    def set_step(self, state: int, symbol: int, to: int) -> None:
        self.step[state << 9 | symbol] = to

    def split(self, state: int, symbol: int, to: int) -> int:
        """A state for the shorter parts of ``to``, which end in more places than its longer ones."""
        step = self.step
        made = self.state(self.longest[state] + 1, self.link[to], list(self.out[to]))
        for x in self.out[to]:
            step[made << 9 | x] = step[to << 9 | x]
        self.link[to] = made
        while state >= 0 and step.get(state << 9 | symbol) == to:
            step[state << 9 | symbol] = made
            state = self.link[state]
        return made

    def add(self, symbols: list[int]) -> int:
        """Adds one sequence and returns the state that it ends in."""
        step, last = self.step, 0
        for x in symbols:
            to = step.get(last << 9 | x)
            if to is not None:
                last = to if self.longest[to] == self.longest[last] + 1 else self.split(last, x, to)
                continue
            at, last = last, self.state(self.longest[last] + 1, 0, [])
            while at >= 0 and (at << 9 | x) not in step:
                step[at << 9 | x] = last
                self.out[at].append(x)
                at = self.link[at]
            if at >= 0:
                to = step[at << 9 | x]
                self.link[last] = to if self.longest[to] == self.longest[at] + 1 else self.split(at, x, to)
        return last


class Bpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            doc = json.load(f)
        model = doc["model"]
        vocab = model["vocab"]
        self.special = {x["content"]: x["id"] for x in doc["added_tokens"]}
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.byte = {x: b for b, x in enumerate(byte_characters())}
        self.read_vocabulary(vocab, [x if isinstance(x, list) else x.split(" ") for x in model["merges"]])
        splits = [x["pattern"]["Regex"] for x in doc["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"]
        # below U+0250 letters and digits are listed: Python's re is fast, and no Unicode version moves them
        listed = splits[0].replace("\\p{L}", characters("L", FIRST_UNUSUAL)).replace("\\p{N}", characters("N", FIRST_UNUSUAL)).replace("\\s", SPACE)
        plain = splits[0].replace("\\p{L}", characters("L", 128)).replace("\\p{N}", characters("N", 128)).replace("\\s", "\\t-\\r ")
        self.find_listed, self.find_plain = re.compile(listed).findall, re.compile(plain).findall
        self.unusual = re.compile(f"[^\\x00-{chr(FIRST_UNUSUAL - 1)}]").search
        self.specials = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.space = re.compile(f"[{SPACE}]")
        self.pieces = re.compile(f"[^{SPACE}]+").findall
        whole = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = whole.normalizer, whole.pre_tokenizer
        self.forget()

    def read_vocabulary(self, vocab: dict[str, int], merges: list[list[str]]) -> None:
        """Tables of merges by pair and by token, and of the automaton's steps, links and tokens; compact arrays, as each worker holds them."""
        ids = max(vocab.values()) + 1
        # by token: its symbols' number, its merge's place (-1: none) and the two tokens that it merges (itself: none)
        self.length, self.rank = array("q", bytes(8 * ids)), array("q", [-1]) * ids
        self.left, self.right = array("q", range(ids)), array("q", range(ids))
        ranks = {}
        for rank, (a, b) in enumerate(merges):
            if a + b in vocab:
                left, right, whole = vocab[a], vocab[b], vocab[a + b]
                ranks[left << 20 | right] = rank
                self.rank[whole], self.left[whole], self.right[whole] = rank, left, right
        self.merge_keys = array("q", sorted(ranks))
        self.merge_ranks = array("q", map(ranks.__getitem__, self.merge_keys))
        self.never = len(merges) + 1
        spelled = []
        for token, i in vocab.items():
            ends = token.endswith(WORD_END)
            symbols = [self.byte[x] for x in (token[: -len(WORD_END)] if ends else token)]
            symbols[-1] += LAST * ends
            spelled.append(symbols)
            self.length[i] = len(symbols)
        automaton = SuffixAutomaton(spelled)
        self.step_keys = array("q", sorted(automaton.step))
        self.step_to = array("q", map(automaton.step.__getitem__, self.step_keys))
        self.longest, self.link = array("q", automaton.longest), array("q", automaton.link)
        # by state: its token (-1: none); top: the nearest state with a token on its path of links, up: the next one after that
        states = len(self.link)
        self.token, self.top, self.up = array("q", [-1]) * states, array("q", bytes(8 * states)), array("q", bytes(8 * states))
        for state, i in zip(automaton.final, vocab.values(), strict=True):
            self.token[state] = i
        for state in sorted(range(1, states), key=self.longest.__getitem__):
            above = self.top[self.link[state]]
            self.top[state], self.up[state] = (state, above) if self.token[state] >= 0 else (above, 0)
        # numpy's view of each of them
        self.np = {name: np.frombuffer(x, np.int64) for name, x in vars(self).items() if isinstance(x, array)}
        self.pair_keys, self.pair_fits = np.full(PAIR_SLOTS, -1, np.int64), np.zeros(PAIR_SLOTS, bool)

    def forget(self) -> None:
        """Drops what was remembered about texts."""
        #: by word: its ids, and the names of its tokens, both as text
        self.ids: dict[str, str] = {}
        self.shown: dict[str, str] = {}

    def fits(self, a: int, b: int) -> bool:
        """Whether merging leaves ``a`` and ``b`` side by side: no merge across their border comes before those that made them."""
        rank, keys = self.rank, self.merge_keys
        limit = self.never
        while True:
            key = a << 20 | b
            at = bisect_left(keys, key)
            if at < len(keys) and keys[at] == key and self.merge_ranks[at] < limit:
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, self.right[a]
            else:
                limit, b = rb + 1, self.left[b]

    def word_ids(self, word: bytes) -> list[int]:
        """Ids of one word."""
        symbols = [*word]
        symbols[-1] += LAST
        keys, link, longest, length = self.step_keys, self.link, self.longest, self.length
        last = [-1]  # last[i]: the last token of the prefix of i symbols
        state = size = 0
        for at, x in enumerate(symbols, 1):
            while True:
                place = bisect_left(keys, state << 9 | x)
                if place < len(keys) and keys[place] == state << 9 | x:
                    break
                state = link[state]
                size = longest[state]
            state, size = self.step_to[place], size + 1
            # of a state entered by a shorter part only what its link holds ends here
            path = self.top[state if size == longest[state] else link[state]]
            while length[self.token[path]] < at and not self.fits(last[at - length[self.token[path]]], self.token[path]):
                path = self.up[path]
            last.append(self.token[path])
        ids, at = [], len(symbols)
        while at:
            ids.append(last[at])
            at -= length[last[at]]
        ids.reverse()
        return ids

    def all_stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``fits`` of many pairs."""
        keys, merge_ranks, ranks, never = self.np["merge_keys"], self.np["merge_ranks"], self.np["rank"], self.never
        fits, at, limit = np.ones(len(a), bool), np.arange(len(a)), np.full(len(a), never)
        while len(at):
            key = a << 20 | b
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            merged = np.where(keys[place] == key, merge_ranks[place], never) < limit
            fits[at[merged]] = False
            ra, rb = ranks[a], ranks[b]
            on = ~merged & ((ra >= 0) | (rb >= 0))
            left = (ra > rb)[on]
            at, a, b, ra, rb = at[on], a[on], b[on], ra[on], rb[on]
            limit = np.where(left, ra, rb + 1)
            a, b = np.where(left, self.np["right"][a], a), np.where(left, b, self.np["left"][b])
        return fits

    def all_fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The same; what was solved stays in a table with one slot a hash."""
        key = a << 20 | b
        slot = (key * 0x9E3779B97F4A7C1 >> 20) % PAIR_SLOTS
        fits, new = self.pair_fits[slot], self.pair_keys[slot] != key
        if new.any():
            fits[new] = self.all_stay_apart(a[new], b[new])
            self.pair_keys[slot[new]] = key[new]
            # of pairs that share a slot the last one has it
            self.pair_fits[slot[new]] = fits[new]
        return fits

    def all_word_ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``word_ids`` of many words, a symbol of all of them at a time: the ids one after another, and each word's count."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(sizes) - sizes
        symbols = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        symbols[begin + sizes - 1] += LAST
        order = np.argsort(-sizes, kind="stable")  # the words that go on are the first ones
        begins = begin[order]
        going = len(words) - np.cumsum(np.bincount(sizes))
        keys, to, links, longests, tops, ups, tokens, lengths = (self.np[x] for x in ("step_keys", "step_to", "link", "longest", "top", "up", "token", "length"))
        last = np.zeros(len(symbols), np.int64)
        state, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for at in range(len(going) - 1):
            n = going[at]
            start, state, size = begins[:n], state[:n], size[:n]
            symbol, todo = symbols[start + at], np.arange(n)
            while len(todo):
                key = state[todo] << 9 | symbol[todo]
                place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                found = keys[place] == key
                state[todo[found]] = to[place[found]]
                size[todo[found]] += 1
                todo = todo[~found]
                state[todo] = links[state[todo]]
                size[todo] = longests[state[todo]]
            path = tops[np.where(size == longests[state], state, links[state])]
            todo = np.arange(n)
            while len(todo):
                token = tokens[path[todo]]
                length, end = lengths[token], start[todo] + at
                fits = length == at + 1
                inner = np.flatnonzero(~fits)
                fits[inner] = self.all_fit(last[end[inner] - length[inner]], token[inner])
                last[end[fits]] = token[fits]
                todo = todo[~fits]
                path[todo] = ups[path[todo]]
        chosen, at, first = np.zeros(len(symbols), bool), begin + sizes - 1, begin
        while len(at):
            chosen[at] = True
            at = at - lengths[last[at]]
            on = at >= first
            at, first = at[on], first[on]
        return last[chosen], np.add.reduceat(chosen, begin, dtype=np.int64)

    def words(self, text: str) -> list[str]:
        """The words of a text; a special token stands for itself.

        Below U+0250 normal form and lower case are spelled out here; elsewhere
        the Unicode version of the tokenizers library decides what is a letter
        and what its lower case.
        """
        if self.specials and "<" in text and self.specials.search(text):
            return [w for x in self.specials.split(text) for w in ([x] if x in self.special else self.words(x))]
        if text.isascii():
            return self.find_plain(text.lower())
        if not self.unusual(text):
            return self.find_listed(unicodedata.normalize("NFC", text).lower())
        found: list[str] = []
        for piece in self.pieces(text):
            if self.unusual(piece):
                shown = [x for x, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(piece))]
                found += [bytes([self.byte[c] for c in x]).decode() for x in shown]
            else:
                found += self.find_listed(unicodedata.normalize("NFC", piece).lower())
        return found

    def learn(self, words: Iterable[list[str]]) -> None:
        """Solves each distinct word not yet remembered."""
        asked = set(chain.from_iterable(words))
        if len(self.ids) + len(asked) > MEMO:
            for memo in (self.ids, self.shown):
                kept = {w: memo[w] for w in asked & memo.keys()}
                memo.clear()
                memo.update(kept)
        new = [*(asked - self.ids.keys())]
        coded = [word.encode() for word in new]
        usual, found = [], {}
        for i, word in enumerate(new):
            if word in self.special:
                found[i] = [self.special[word]]
            elif len(coded[i]) > LONG:
                found[i] = self.word_ids(coded[i])
            else:
                usual.append(i)
        if usual:
            ids, counts = self.all_word_ids([coded[i] for i in usual])
            ids, ends = ids.tolist(), np.cumsum(counts).tolist()
            found |= {i: ids[a:b] for i, a, b in zip(usual, [0, *ends], ends, strict=False)}
        names = self.names
        for i, ids in found.items():
            self.ids[new[i]] = " ".join(map(str, ids))
            self.shown[new[i]] = " ".join([names[i] for i in ids])

    def parts_of(self, text: str) -> Iterator[str]:
        """The text, in parts of about GROUP characters that end at white space."""
        at = 0
        while len(text) - at > GROUP and (cut := self.space.search(text, at + GROUP)):
            yield text[at : cut.start()]
            at = cut.end()
        yield text[at:] if at else text

    def coded(self, texts: Iterable[str | None]) -> Iterator[tuple[str, str]]:
        """Per text: its ids, and its tokens' names, both as text with blanks between."""
        parts = ((row, part) for row, text in enumerate(texts) for part in self.parts_of(text or ""))
        solved = chain.from_iterable(map(self.solved, grouped(parts)))
        for _, found in groupby(solved, itemgetter(0)):
            _, ids, shown = zip(*found, strict=True)
            yield (ids[0], shown[0]) if len(ids) == 1 else (" ".join(filter(None, ids)), " ".join(filter(None, shown)))

    def solved(self, parts: list[tuple[int, str]]) -> Iterator[tuple[int, str, str]]:
        words = [self.words(part) for _, part in parts]
        self.learn(words)
        ids, shown = self.ids.__getitem__, self.shown.__getitem__
        for (row, _), found in zip(parts, words, strict=True):
            yield row, " ".join(map(ids, found)), " ".join(map(shown, found))

    def encode(self, text: str | None) -> list[int]:
        return [int(x) for ids, _ in self.coded([text]) for x in ids.split()]

    def decode(self, ids: list[int]) -> str:
        """Token names side by side, by blanks: the file names no decoder that would join them."""
        return " ".join([self.names[i] for i in ids])


def grouped(parts: Iterable[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    """The parts in order, about GROUP characters at a time."""
    group: list[tuple[int, str]] = []
    held = 0
    for x in parts:
        group.append(x)
        held += len(x[1])
        if held > GROUP:
            yield group
            group, held = [], 0
    yield group


@cache
def loaded(path: str) -> Bpe:
    bpe = Bpe(path)
    give_back()  # of the automaton only the tables stay
    return bpe


def _encoded(path: str, with_ids: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bpe = loaded(path)
    try:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                yield _encoded_batch(bpe, with_ids, batch.slice(at, ROWS))
    finally:
        bpe.forget()  # the worker may go on to other stages


def _encoded_batch(bpe: Bpe, with_ids: bool, batch: pa.RecordBatch) -> pa.RecordBatch:
    counts, kept, digests, decoded = [], [], [], []
    for ids, shown in bpe.coded(batch.column("text").to_pylist()):
        counts.append(ids.count(" ") + 1 if ids else 0)
        digests.append(hashlib.sha256(ids.encode()).hexdigest())
        decoded.append(hashlib.sha256(shown.encode()).hexdigest())
        if with_ids:
            kept.append(np.fromstring(ids, np.int32, sep=" ") if ids else np.zeros(0, np.int32))
    rest = [i for i, name in enumerate(batch.schema.names) if name != "text"]
    arrays = [*(batch.column(i) for i in rest), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
    names = [*(batch.schema.names[i] for i in rest), "n_tokens", "ids_sha256", "decoded_sha256"]
    if with_ids:
        ends = pa.array(np.cumsum([0, *counts]), pa.int32())
        arrays, names = [*arrays, pa.ListArray.from_arrays(ends, pa.array(np.concatenate(kept)))], [*names, "ids"]
    return pa.RecordBatch.from_arrays(arrays, names)


def encode(rows: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """``rows`` (text and others) with n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids, in place of text."""
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text"]
    out = [*kept, "n_tokens long", "ids_sha256 string", "decoded_sha256 string", *(["ids array<int>"] if with_ids else [])]
    return map_arrow(rows, partial(_encoded, path, with_ids), ", ".join(out))


def _decoded(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bpe = loaded(path)
    for batch in batches:
        rest = [i for i, name in enumerate(batch.schema.names) if name != "ids"]
        texts = [bpe.decode(x.as_py() or []) for x in batch.column("ids")]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(texts, pa.string())], [*(batch.schema.names[i] for i in rest), "text"])


def decode(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` (ids and others) with the decoded text in place of ids."""
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "ids"]
    return map_arrow(rows, partial(_decoded, path), ", ".join([*kept, "text string"]))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of ``docs``."""
    return encode(docs.select("doc_id", F.col("text")), path, with_ids=False)
