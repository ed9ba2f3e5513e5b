"""Main text of web pages by a recurrent labeller of text blocks.

A page is cut into leaf blocks: stretches of text between block-level tags.
Each block has a vector of its tag path (the mean of learnt vectors of hashed
tags, classes, ids and roles of all open elements), a vector of its words (the
mean of learnt vectors of hashed words, all of them) and a few counts. A
bidirectional LSTM in numpy reads the whole sequence and labels every block as
main text or not, so each label depends on the entire page.

The model is trained here, from a fixed seed, on generated pages whose blocks'
roles are known; it reads no table. Its weights (about 100 kB) travel with the
function that labels.

Cases with a defined result: null, empty and blank pages have the empty text;
text outside any tag is a block like any other; unclosed and stray tags are
tolerated; null page_id and url are carried along; repeated rows each get their
row; very long pages are labelled whole; extra columns are not read.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.shipping import map_arrow

PATH_ROWS, PATH_DIM = 1024, 12
WORD_ROWS, WORD_DIM = 2048, 8
COUNTS = 5
HIDDEN = 16
TRAIN_PAGES = 2000
EPOCHS = 12
BATCH = 28
RATE = 0.01
#: Word vectors shrink unless words tell something everywhere: the words of generated pages are not those of real ones.
DECAY = {"word": 0.5}
SEED = 5
#: Blocks that go through the network together.
BLOCKS_AT_ONCE = 8192
MEMO = 200_000

#: Elements that end a block, elements whose content is never shown as text, elements without content.
BORDERS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead tr ul".split()
)
HIDDEN_TEXT = frozenset("script style title textarea noscript template iframe object canvas audio video svg math xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BORDERS - frozenset("body button caption head html optgroup option tbody td tfoot th thead tr".split())

#: Of a tag only its name; comments and declarations whole.
OPEN = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/><]*+))", re.S)
#: What follows the name: with quoted values, which may hold a >, and without regard to quotes. Neither tries twice.
QUOTED = re.compile(r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
LOOSE = re.compile(r"([^>]*+)>")
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in HIDDEN_TEXT}
#: Of the elements above those where a slash before the > ends the element; HTML gives it no meaning elsewhere.
FOREIGN = frozenset("svg math".split())


class Paths:
    """Tag paths as numbers: a path is its parent and the hashed names of its last element."""

    def __init__(self) -> None:
        self.known: dict[tuple[int, str], int] = {}
        self.parent, self.rows = [0], [()]

    def child(self, parent: int, tag: str, attributes: str) -> int:
        names = " ".join(x.strip("\"'") for x in NAMES.findall(attributes)) if "=" in attributes else ""
        key = (parent, f"{tag} {names}")
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = len(self.parent)
            self.parent.append(parent)
            tokens = [f"<{tag}>", *(x.lower() for x in PARTS.findall(names))]
            self.rows.append(tuple(zlib.crc32(x.encode()) % PATH_ROWS for x in tokens))
        return found


@dataclass
class Block:
    path: int
    text: str
    linked: int


def blocks(page: str | None, paths: Paths) -> list[Block]:
    """The text blocks of a page in order, in time that grows with the page's length.

    Tags end as in HTML: quoted values may hold a >, a slash ends nothing but
    void and foreign elements, an unfinished last tag is no text. If a quote is
    never closed, quotes have no meaning from that tag on.
    """
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, int]] = []
    depth: dict[str, int] = {}  # open elements by name
    parts: list[str] = []
    path, linked, at, links = 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(" ".join(parts).split()) if len(parts) > 1 else " ".join(parts[0].split()) if parts else ""
        if text:
            out.append(Block(path, text, min(linked, len(text))))
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            raw = html.unescape(raw) if "&" in raw else raw
            if parts:
                parts[-1] += raw
            else:
                parts.append(raw)
            if links:
                linked += len(raw.strip())

    def pop_to(name: str) -> None:
        nonlocal path, links
        while stack:
            tag, before = stack.pop()
            depth[tag] -= 1
            links -= tag == "a"
            path = before
            if tag == name:
                return

    end, last = len(page), page.rfind(">")
    rest = QUOTED
    while at < end:
        m = OPEN.search(page, at)
        add(page[at : m.start()] if m else page[at:])
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        if at > last:  # no tag ends after here
            break
        attributes = rest.match(page, at)
        if not attributes:  # a quote that never ends: from here on quotes hide nothing, so no place is read again and again
            rest = LOOSE
            attributes = rest.match(page, at)
        at = attributes.end()
        tag = m[2].lower()
        if m[1]:
            if depth.get(tag):
                if tag in BORDERS:
                    flush()
                pop_to(tag)
            elif tag in BORDERS:
                flush()
            continue
        if tag in BORDERS:
            flush()
            if tag in CLOSES_P and depth.get("p"):
                pop_to("p")
            if tag == "li" and stack and stack[-1][0] == "li":
                pop_to("li")
        if tag == "br":
            add(" ")
        if tag in VOID or (tag in FOREIGN and attributes[1].endswith("/")):
            continue
        if tag in HIDDEN_TEXT:
            close = END[tag].search(page, at)
            at = close.end() if close else end
            continue
        stack.append((tag, path))
        depth[tag] = depth.get(tag, 0) + 1
        links += tag == "a"
        path = paths.child(path, tag, attributes[1])
    flush()
    return out


# ---- features


def word_row(word: str) -> int:
    return zlib.crc32(word.strip(".,;:!?\"'()[]").lower().encode("utf-8", "replace")) % WORD_ROWS


@dataclass
class Features:
    """Blocks as arrays: rows of path and word vectors with where each path or block begins, and counts."""

    path: np.ndarray  # of each block, among all paths
    parents: np.ndarray  # a path's parent comes before it
    levels: list[np.ndarray]  # the paths of each depth that has any
    path_rows: np.ndarray  # of a path's own last element
    path_owner: np.ndarray
    path_sizes: np.ndarray  # elements' names on the whole path
    n_paths: int
    word_rows: np.ndarray
    word_owner: np.ndarray
    counts: np.ndarray


def features(found: list[Block], paths: Paths, memo: dict[str, int]) -> Features:
    used: set[int] = set()
    for p in {b.path for b in found}:
        while p not in used:
            used.add(p)
            p = paths.parent[p]
    ordered = sorted(used | {0})
    place = {p: i for i, p in enumerate(ordered)}
    parents = np.array([place[paths.parent[p]] for p in ordered])
    rows = [r for p in ordered for r in paths.rows[p]]
    own = np.array([len(paths.rows[p]) for p in ordered])
    owner = np.repeat(np.arange(len(ordered)), own)
    whole = own.tolist()
    steps = [0] * len(ordered)
    for i, up in enumerate(parents.tolist()):
        if i:
            steps[i] = steps[up] + 1
            whole[i] += whole[up]
    depth = np.array(steps)
    by_depth = np.argsort(depth, kind="stable")
    levels = np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1)[1:]
    words, sizes = [], []
    for b in found:
        ws = b.text.split()
        for w in ws:
            r = memo.get(w)
            if r is None:
                if len(memo) >= MEMO:
                    memo.clear()
                r = memo[w] = word_row(w)
            words.append(r)
        sizes.append(len(ws))
    sizes = np.array(sizes)
    chars = np.array([len(b.text) for b in found], float)
    linked = np.array([b.linked for b in found], float)
    stops = np.array([b.text.count(".") + b.text.count(",") + b.text.count("?") + b.text.count("!") for b in found], float)
    ended = np.array([b.text[-1] in ".!?…\"”»" for b in found], float)
    counts = np.stack((np.log1p(sizes) / 4, linked / chars, np.minimum(stops / sizes, 1), ended, (sizes > 12).astype(float)), axis=1).astype(np.float32)
    of = np.repeat(np.arange(len(found)), sizes)
    path = np.array([place[b.path] for b in found])
    return Features(path, parents, levels, np.array(rows, int), owner, np.array(whole), len(ordered), np.array(words, int), of, counts)


def sum_rows(table: np.ndarray, rows: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The sum of the table's ``rows`` of each owner; owners ascend, and those without rows get zeros."""
    out = np.zeros((n, table.shape[1]), table.dtype)
    if len(rows):
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        out[owner[first]] = np.add.reduceat(table[rows], first, axis=0)
    return out


def mean_rows(table: np.ndarray, rows: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The mean of the table's ``rows`` of each owner."""
    return sum_rows(table, rows, owner, n) / np.maximum(np.bincount(owner, minlength=n), 1)[:, None].astype(table.dtype)


# ---- the network


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def new_parameters() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(SEED)
    wide = PATH_DIM + WORD_DIM + COUNTS
    p = {"path": rng.normal(0, 0.3, (PATH_ROWS, PATH_DIM)), "word": rng.normal(0, 0.1, (WORD_ROWS, WORD_DIM))}
    for side in ("f", "b"):
        p[f"wx{side}"] = rng.normal(0, wide**-0.5, (wide, 4 * HIDDEN))
        p[f"wh{side}"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
        p[f"bias{side}"] = np.concatenate((np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)))
    p["out"] = rng.normal(0, 0.3, 2 * HIDDEN)
    p["bias"] = np.zeros(1)
    return {k: v.astype(np.float32) for k, v in p.items()}


def lstm(x: np.ndarray, mask: np.ndarray, wx: np.ndarray, wh: np.ndarray, bias: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (time, batch, HIDDEN) of (time, batch, width) inputs; past its end a sequence's state stays."""
    t, n, _ = x.shape
    h, c = np.zeros((n, HIDDEN), x.dtype), np.zeros((n, HIDDEN), x.dtype)
    gates = x @ wx + bias
    out = np.empty((t, n, HIDDEN), x.dtype)
    for k in range(t):
        z = gates[k] + h @ wh
        i, f, o = sigmoid(z[:, :HIDDEN]), sigmoid(z[:, HIDDEN : 2 * HIDDEN]), sigmoid(z[:, 3 * HIDDEN :])
        g = np.tanh(z[:, 2 * HIDDEN : 3 * HIDDEN])
        m = mask[k][:, None]
        before = c
        c = np.where(m, f * c + i * g, c)
        tc = np.tanh(c)
        if keep is not None:
            keep.append((h, before, i, f, g, o, tc, m))
        h = np.where(m, o * tc, h)
        out[k] = h
    return out


def lstm_back(x: np.ndarray, grad: np.ndarray, wx: np.ndarray, wh: np.ndarray, keep: list) -> tuple[np.ndarray, ...]:
    """Gradients of the inputs, wx, wh and the bias."""
    t, n, _ = x.shape
    dh, dc = np.zeros((n, HIDDEN), x.dtype), np.zeros((n, HIDDEN), x.dtype)
    dz = np.zeros((t, n, 4 * HIDDEN), x.dtype)
    dwh = np.zeros_like(wh)
    for k in range(t - 1, -1, -1):
        h, before, i, f, g, o, tc, m = keep[k]
        dh = dh + grad[k]
        now = np.where(m, dh, 0)
        dct = np.where(m, dc + now * o * (1 - tc * tc), 0)
        z = np.concatenate((dct * g * i * (1 - i), dct * before * f * (1 - f), dct * i * (1 - g * g), now * tc * o * (1 - o)), axis=1)
        dz[k] = z
        dwh += h.T @ z
        dh = np.where(m, z @ wh.T, dh)
        dc = np.where(m, dct * f, dc)
    flat = dz.reshape(t * n, -1)
    return (flat @ wx.T).reshape(x.shape), x.reshape(t * n, -1).T @ flat, dwh, flat.sum(0)


def layout(lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mask, forward, backward): for each time and sequence the block read there, by either direction."""
    size = np.array(lengths)
    begin = np.cumsum(size) - size
    time = np.arange(size.max())[:, None]
    mask = time < size
    forward = np.where(mask, begin + time, 0)
    return mask, forward, np.where(mask, begin + size - 1 - time, 0)


def vectors(p: dict[str, np.ndarray], f: Features) -> np.ndarray:
    sums = sum_rows(p["path"], f.path_rows, f.path_owner, f.n_paths)
    for level in f.levels:  # a path's sum is its parent's and its own
        sums[level] += sums[f.parents[level]]
    path = (sums / np.maximum(f.path_sizes, 1)[:, None].astype(sums.dtype))[f.path]
    return np.concatenate((path, mean_rows(p["word"], f.word_rows, f.word_owner, len(f.path)), f.counts), axis=1)


def logits(p: dict[str, np.ndarray], f: Features, lengths: list[int]) -> np.ndarray:
    x = vectors(p, f)
    mask, forward, backward = layout(lengths)
    h = np.zeros((len(x), 2 * HIDDEN), x.dtype)
    for side, index, part in (("f", forward, slice(0, HIDDEN)), ("b", backward, slice(HIDDEN, None))):
        h[index[mask], part] = lstm(x[index], mask, p[f"wx{side}"], p[f"wh{side}"], p[f"bias{side}"])[mask]
    return h @ p["out"] + p["bias"]


def gradients(p: dict[str, np.ndarray], f: Features, lengths: list[int], y: np.ndarray) -> dict[str, np.ndarray]:
    x = vectors(p, f)
    mask, forward, backward = layout(lengths)
    h = np.zeros((len(x), 2 * HIDDEN), x.dtype)
    kept: dict[str, list] = {"f": [], "b": []}
    sides = (("f", forward, slice(0, HIDDEN)), ("b", backward, slice(HIDDEN, None)))
    for side, index, part in sides:
        h[index[mask], part] = lstm(x[index], mask, p[f"wx{side}"], p[f"wh{side}"], p[f"bias{side}"], kept[side])[mask]
    error = ((sigmoid(h @ p["out"] + p["bias"]) - y) / len(y)).astype(np.float32)
    g = {"out": h.T @ error, "bias": np.array([error.sum()])}
    dh, dx = error[:, None] * p["out"], np.zeros_like(x)
    for side, index, part in sides:
        grad = np.where(mask[:, :, None], dh[index, part], 0)
        di, g[f"wx{side}"], g[f"wh{side}"], g[f"bias{side}"] = lstm_back(x[index], grad, p[f"wx{side}"], p[f"wh{side}"], kept[side])
        dx[index[mask]] += di[mask]
    by_path = np.stack([np.bincount(f.path, dx[:, d], f.n_paths) for d in range(PATH_DIM)], axis=1)
    by_path /= np.maximum(f.path_sizes, 1)[:, None]
    for level in reversed(f.levels):
        np.add.at(by_path, f.parents[level], by_path[level])
    g["path"] = np.stack([np.bincount(f.path_rows, by_path[f.path_owner, d], PATH_ROWS) for d in range(PATH_DIM)], axis=1)
    by_block = dx[:, PATH_DIM : PATH_DIM + WORD_DIM] / np.maximum(np.bincount(f.word_owner, minlength=len(x)), 1)[:, None]
    g["word"] = np.stack([np.bincount(f.word_rows, by_block[f.word_owner, d], WORD_ROWS) for d in range(WORD_DIM)], axis=1)
    return g


# ---- generated pages to learn from

SYLLABLES = "an the er on re tion in st ou ha sch ver ung de ge be le eau men ció os pa ra la qui vo".split()
SMALL = "Home|About us|Contact|News|Sports|Login|Sign up|Search|Menu|Privacy policy|Terms|Share|Tweet|Next|Previous|Read more|Subscribe|Impressum|Datenschutz|Kontakt|Startseite|Accueil|Mentions légales|Inicio|Contacto|Archive|Tags|Related".split("|")
NOTES = "We use cookies to improve this site.|Accept all cookies|Diese Seite verwendet Cookies.|Ce site utilise des cookies.|Este sitio usa cookies.|Please disable your ad blocker.|Subscribe to our newsletter for updates.|Advertisement|Anzeige|Publicité|Sponsored content".split("|")
MAIN = "content post entry article story text body main post-content article-body entry-content prose".split()
ASIDE = {
    "ad": "ad ads advert advertisement banner sponsor sponsored promo ad-slot adsbox",
    "notice": "notice cookie cookie-banner cookies consent alert gdpr popup notification message",
    "comments": "comments comment comment-list replies discussion reader-comments responses respond",
    "sidebar": "sidebar side widget related aside recommended links sidebar-left tags archive most-read",
    "menu": "menu nav navigation navbar breadcrumb breadcrumbs topnav toc pagination pager",
    "footer": "footer copyright colophon legal bottom site-footer",
    "header": "header masthead site-header top logo branding topbar",
    "form": "form search newsletter subscribe login signup contact-form",
    "share": "share social sharing buttons follow meta byline tools",
}


SIDES = "left right top main site page inner wrap area list block region col".split()


class Author:
    """Writes pages as (html, is each text block main text); the blocks come in the order ``blocks`` finds them."""

    def __init__(self, seed: int) -> None:
        self.rng = random.Random(seed)

    def word(self) -> str:
        return "".join(self.rng.choice(SYLLABLES) for _ in range(self.rng.choice((1, 1, 2, 2, 3))))

    def sentence(self, low: int, high: int) -> str:
        words = [self.word() + ("," if self.rng.random() < 0.08 else "") for _ in range(self.rng.randint(low, high))]
        return " ".join(words).capitalize() + self.rng.choice("....?!")

    def prose(self, n: int) -> str:
        noise = self.rng.random() < 0.1
        out = []
        for w in " ".join(self.sentence(3, 16) for _ in range(n)).split():
            x = self.rng.random()
            w += self.rng.choice(("###", "***", "&amp;&amp;", "%%%", "$$$")) if noise else ""
            out.append(f"<b>{w}</b>" if x < 0.01 else f"<i>{w}</i>" if x < 0.02 else f'<a href="/x">{w}</a>' if x < 0.035 else w)
        return " ".join(out)

    def label(self) -> str:
        return self.rng.choice(SMALL) if self.rng.random() < 0.6 else self.word().capitalize()

    def named(self, kind: str) -> str:
        r = self.rng
        name = r.choice(ASIDE[kind].split()) if kind in ASIDE else r.choice(MAIN)
        if r.random() < 0.25:  # names of another make: what is around a block has to tell
            name = r.choice((f"{r.choice(SIDES)}-{name}", f"{r.choice(SIDES)}{name}", f"{name}-{r.choice(SIDES)}", self.word()))
        name += r.choice(("", "", "", "-1", " box", " clearfix"))
        return f' {self.rng.choice(("class", "class", "class", "id"))}="{name}"'

    def links(self) -> tuple[str, list[int]]:
        n = self.rng.randint(1, 8)
        if self.rng.random() < 0.7:
            return "<ul>" + "".join(f'<li><a href="/{self.word()}">{self.label()}</a></li>' for _ in range(n)) + "</ul>", [0] * n
        return "<div>" + " | ".join(f'<a href="#">{self.label()}</a>' for _ in range(n)) + "</div>", [0]

    def menu_links(self) -> tuple[str, list[int]]:
        """Links of a menu, some without any element of their own around them."""
        if self.rng.random() < 0.8:
            return self.links()
        return self.rng.choice((" ", "<br>", " &middot; ")).join(f'<a href="/{self.word()}">{self.label()}</a>' for _ in range(self.rng.randint(1, 8))), [0]

    def aside(self, kind: str) -> tuple[str, list[int]]:
        r = self.rng
        tag = {"menu": "nav", "footer": "footer", "header": "header", "sidebar": "aside", "form": "form"}.get(kind, "div")
        plain = r.random() < 0.45
        open_, close = (f"<{tag}>", f"</{tag}>") if plain and tag != "div" else ((f"<{tag}{self.named(kind)}>", f"</{tag}>") if r.random() < 0.4 else (f"<{r.choice(('div', 'section'))}{self.named(kind)}>", "</div>"))
        if open_.startswith("<section"):
            close = "</section>"
        parts: list[str] = []
        y: list[int] = []

        def put(text: str, tag: str | None = None) -> None:
            parts.append(f"<{tag}>{text}</{tag}>" if tag else f"<div>{text}</div>")
            y.append(0)

        if kind == "menu":
            inner, n = self.menu_links()
            parts.append(inner)
            y += n
        elif kind in ("ad", "notice"):
            bare = r.random()
            text = r.choice(NOTES) if r.random() < 0.35 else self.prose(r.randint(1, 3))
            if bare < 0.5:
                parts.append(text)
                y.append(0)
            else:
                put(text, "p")
            if r.random() < 0.3:
                put(self.label(), "button")
        elif kind == "comments":
            if r.random() < 0.8:
                put(r.choice(("Comments", "Kommentare", "Commentaires", "3 comments", "Leave a reply", "Comentarios")), r.choice(("h2", "h3", "h4")))
            if r.random() < 0.2:
                n = r.randint(1, 4)
                parts.append(f'<ol class="{r.choice(("commentlist", "comment-list", "replies"))}">' + "".join(f"<li><p>{self.prose(r.randint(1, 3))}</p></li>" for _ in range(n)) + "</ol>")
                y += [0] * n
            for _ in range(r.randint(1, 5)):
                box = r.random() < 0.6
                parts.append(f'<div class="{r.choice(("comment", "reply", "comment-body"))}">' if box else "<div>")
                if r.random() < 0.6:
                    put(f"{self.word().capitalize()} wrote:", r.choice(("p", "div")))
                put(self.prose(r.randint(1, 4)), "p")
                parts.append("</div>")
        elif kind == "sidebar":
            if r.random() < 0.7:
                put(self.label(), r.choice(("h2", "h3", "h4")))
            if r.random() < 0.6:
                inner, n = self.links()
                parts.append(inner)
                y += n
            else:
                put(self.prose(r.randint(1, 3)), "p")
        elif kind == "footer":
            if r.random() < 0.4:
                inner, n = self.links()
                parts.append(inner)
                y += n
            text = f"&copy; {self.word()}.example.com &middot; {self.sentence(2, 14)}" if r.random() < 0.8 else f"Copyright 20{r.randint(10, 30)} {self.word()}"
            if r.random() < 0.6:
                parts.append(text)
                y.append(0)
            else:
                put(text, "p")
        elif kind == "header":
            put(self.label(), r.choice(("div", "h1", "h2", "p")))
            if r.random() < 0.5:
                put(self.sentence(2, 9), "p")
        elif kind == "form":
            for _ in range(r.randint(1, 3)):
                put(f'<label>{self.label()}</label><input name="x">')
            if r.random() < 0.5:
                put(self.sentence(3, 12), "p")
            put(self.label(), "button")
        else:
            if r.random() < 0.5:
                put(f"{self.word().capitalize()} {self.word().capitalize()}, 2{r.randint(100, 999)}")
            inner, n = self.links()
            parts.append(inner)
            y += n
        return open_ + "".join(parts) + close, y

    def article(self) -> tuple[str, list[int]]:
        r = self.rng
        parts, y = [], []
        style = r.random()
        if r.random() < 0.85:
            parts.append(f"<h1>{self.sentence(3, 10)}</h1>" if style < 0.8 else f"<h2>{self.sentence(3, 10)}</h2>")
            y.append(1)
        if r.random() < 0.15:
            inner, n = self.aside("share")
            parts.append(inner)
            y += n
        loose = r.random() < 0.25
        for _ in range(r.choice((1, 1, 2, 3, 4, 6, 9, 14, 14, 30))):
            x = r.random()
            if x < 0.74:
                body = self.prose(r.choice((1, 1, 2, 3, 5, 8)))
                parts.append(f"<p><b>{body}<br>" if loose and r.random() < 0.5 else f"<p>{body}</p>" if not loose or r.random() < 0.5 else f"<p>{body}")
                y.append(1)
            elif x < 0.82:
                parts.append(f"<{(t := r.choice(('h2', 'h3')))}>{self.sentence(2, 7)[:-1]}</{t}>")
                y.append(1)
            elif x < 0.88:
                n = r.randint(2, 5)
                t = r.choice(("ul", "ol"))
                parts.append(f"<{t}>" + "".join(f"<li>{self.sentence(2, 12)}</li>" for _ in range(n)) + f"</{t}>")
                y += [1] * n
            elif x < 0.92:
                parts.append(f"<blockquote>{self.sentence(5, 20)}</blockquote>")
                y.append(1)
            elif x < 0.94:
                parts.append("<table><tr>" + "".join(f"<td>{self.word()} {r.randint(1, 99)}</td>" for _ in range(3)) + "</tr></table>")
                y += [1] * 3
            elif x < 0.96:
                parts.append(f"<div>{self.prose(2)}</div>")
                y.append(1)
            else:
                inner, n = self.aside(r.choice(("ad", "ad", "notice", "sidebar", "share", "form")))
                parts.append(inner)
                y += n
        return "".join(parts), y

    def page(self) -> tuple[str, list[int]]:
        r = self.rng
        inner, y = self.article()
        x = r.random()
        if r.random() < 0.15:
            more, n = self.aside("comments")
            inner, y = inner + more, y + n
        if x < 0.45:
            inner = f"<article>{inner}</article>"
        elif x < 0.6:
            inner = f"<main>{inner}</main>"
        elif x < 0.9:
            inner = f"<div{self.named('main')}>{inner}</div>"
        elif x < 0.95:
            inner = f"<section>{inner}</section>"
        if x > 0.9 and r.random() < 0.5:  # a page laid out by a table
            rows, n = self.menu_links()
            last = f"Copyright {self.sentence(2, 8)}"
            inner = f"<table><tr><td{self.named('menu')}>{rows}</td><td{self.named('main')}>{inner}</td></tr><tr><td{self.named('footer')}>{last}</td></tr></table>"
            y = [*n, *y, 0]
        if r.random() < 0.2:
            inner = f'<div class="{r.choice(("wrapper", "container", "page", "row", "site"))}">{inner}</div>'
        before, after = [], []
        for kind, chance in (("notice", 0.2), ("header", 0.4), ("menu", 0.75), ("form", 0.15), ("ad", 0.45), ("sidebar", 0.15), ("share", 0.1)):
            if r.random() < chance:
                before.append(self.aside(kind))
        for kind, chance in (("share", 0.15), ("comments", 0.3), ("sidebar", 0.35), ("ad", 0.2), ("form", 0.15), ("menu", 0.1), ("footer", 0.8), ("notice", 0.15)):
            if r.random() < chance:
                after.append(self.aside(kind))
        text = "".join(x for x, _ in before) + inner + "".join(x for x, _ in after)
        labels = [k for _, n in before for k in n] + y + [k for _, n in after for k in n]
        return f"<!DOCTYPE html><html><head><title>{self.word()}</title><style>p{{}}</style></head><body>{text}</body></html>", labels


@cache
def trained() -> dict[str, np.ndarray]:
    """The network after a fixed number of Adam steps on generated pages; fitted once in a process."""
    author = Author(SEED)
    pages, paths, memo = [], Paths(), {}
    for _ in range(TRAIN_PAGES):
        text, labels = author.page()
        found = blocks(text, paths)
        if len(found) == len(labels):
            pages.append((found, labels))
    pages.sort(key=lambda x: len(x[0]))
    batches = []
    for at in range(0, len(pages), BATCH):
        part = pages[at : at + BATCH]
        batches.append((features([b for x, _ in part for b in x], paths, memo), [len(x) for x, _ in part], np.array([k for _, y in part for k in y], float)))
    p = new_parameters()
    first, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    rng = np.random.default_rng(SEED)
    step = 0
    for epoch in range(EPOCHS):
        for i in rng.permutation(len(batches)):
            step += 1
            g = gradients(p, *batches[i])
            scale = min(1.0, 1.0 / (np.sqrt(sum(float((x * x).sum()) for x in g.values())) + 1e-9))
            rate = RATE * (1 - epoch / EPOCHS)
            for k in p:
                first[k] = 0.9 * first[k] + 0.1 * g[k] * scale
                second[k] = 0.99 * second[k] + 0.01 * (g[k] * scale) ** 2
                p[k] -= np.float32(rate) * ((first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8) + DECAY.get(k, 0) * p[k]).astype(np.float32)
    return p


# ---- labelling


def main_texts(p: dict[str, np.ndarray], pages: list[str | None], memo: dict[str, int]) -> list[str]:
    """The main text of each page; pages go through the network some thousands of blocks at a time, sorted by length."""
    paths = Paths()
    found = [blocks(x, paths) for x in pages]
    out = [""] * len(pages)
    todo = sorted((i for i, x in enumerate(found) if x), key=lambda i: len(found[i]))
    at = 0
    while at < len(todo):
        end, size = at + 1, len(found[todo[at]])
        while end < len(todo) and (end - at + 1) * len(found[todo[end]]) <= BLOCKS_AT_ONCE:
            size += len(found[todo[end]])
            end += 1
        part = todo[at:end]
        flat = [b for i in part for b in found[i]]
        main = logits(p, features(flat, paths, memo), [len(found[i]) for i in part]) > 0
        place = 0
        for i in part:
            n = len(found[i])
            out[i] = "\n".join(b.text for b, yes in zip(found[i], main[place : place + n], strict=True) if yes)
            place += n
        at = end
    return out


def _extracted(p: dict[str, np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo: dict[str, int] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = main_texts(p, part.column("html").to_pylist(), memo)
            columns = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame, parameters: dict[str, np.ndarray] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``."""
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_arrow(rows, partial(_extracted, parameters or trained()), f"page_id {kind}, url string, text string, n_chars long")
