"""Flat rows of parsed programs: what the tables of ``operators.cobol`` hold."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from millrace.functions import cobol_parse as cp
from millrace.functions.cobol_data import expand_pic, pic_type, spark_type
from millrace.functions.cobol_sql import table_refs
from millrace.functions.cobol_text import mask_literals, split_outside_literals
from millrace.functions.cobol_words import Words, is_name

OWN_FIELDS = ("t", "line", "origin", "verb", "text", *{f for fields in cp.BODIES.values() for f in fields})
CHARACTER = ("alphanumeric", "alphanumeric-edited", "alphabetic")


def plain_name(source: str) -> str | None:
    """The name that a MOVE source is, perhaps qualified by OF or IN others; null for anything else."""
    words = source.upper().split()
    qualified = all(x in ("OF", "IN") for x in words[1::2]) and len(words) % 2 == 1
    return words[0] if qualified and all(map(is_name, words[::2])) else None


def units(program: dict) -> Iterator[tuple[int, dict]]:
    """(number, program) of the outer program and those it contains."""
    yield 0, program
    yield from enumerate(program["contained"], 1)


def regions(program: dict) -> Iterator[tuple[int, str, int, dict]]:
    """(unit, region, number, paragraph) of all paragraphs."""
    for u, unit in units(program):
        for region, field in (("main", "paragraphs"), ("declaratives", "declaratives")):
            for i, p in enumerate(unit[field]):
                yield u, region, i, p


def paragraph_rows(program: dict) -> Iterator[dict]:
    for u, region, i, p in regions(program):
        yield {"unit": u, "region": region, "para": i} | {k: v for k, v in p.items() if k not in ("t", "statements")}


def statement_rows(program: dict, with_attrs: bool = True) -> Iterator[dict]:
    """Every statement as often as it is walked; ``path`` sorts them in that order and a body's paths begin with its statement's."""

    def rows(body: list[dict], prefix: str, parent: int | None, branch: str | None, condition: str | None) -> Iterator[dict]:
        nonlocal n
        for i, s in enumerate(body):
            own, n = n, n + 1
            path = f"{prefix}{i:04d}"
            attrs = json.dumps({k: v for k, v in s.items() if k not in OWN_FIELDS}) if with_attrs else None
            yield {
                "stmt_id": own, "parent_id": parent, "branch": branch, "condition": condition, "ord": i, "path": path, "node": s["t"],
                "line": s["line"], "origin": s["origin"], "verb": s.get("verb"), "text": s.get("text"), "attrs": attrs,
            }
            if s["t"] in cp.BODIES:
                for name, what, inner in cp.bodies(s):
                    yield from rows(inner, f"{path}.{name}.", own, name, what)

    for u, region, i, p in regions(program):
        n = 0
        for row in rows(p["statements"], "", None, None, None):
            yield {"unit": u, "region": region, "para": i, "paragraph": p["name"]} | row


def item_rows(program: dict) -> Iterator[dict]:
    for u, unit in units(program):
        for i, x in enumerate(unit["data_items"]):
            kind = x["type"] or {}
            yield {
                "unit": u, "item": i, **{k: v for k, v in x.items() if k not in ("t", "type")}, "category": kind.get("category"), "digits": kind.get("digits"),
                "scale": kind.get("scale"), "signed": kind.get("signed"), "spark_type": spark_type(kind) if kind else None,
            }


def structure_rows(program: dict) -> Iterator[dict]:
    """(unit, group, ord, item) of every group that can stand for its items."""
    for u, unit in units(program):
        for name in dict.fromkeys(x["name"] for x in unit["data_items"] if x["is_group"]):
            for i, item in enumerate(cp.host_structure(unit["data_items"], name) or ()):
                yield {"unit": u, "group": name, "ord": i, "item": item}


def exec_statements(program: dict) -> Iterator[tuple[int, str, int, int, dict]]:
    for u, region, i, p in regions(program):
        for n, s in enumerate(cp.walk(p["statements"])):
            if s["t"] == "ExecStmt":
                yield u, region, i, n, s


def column_rows(program: dict) -> Iterator[dict]:
    """Columns and the host variables they meet."""
    for u, region, i, n, s in exec_statements(program):
        for k, pair in enumerate(s["columns"]):
            yield {
                "unit": u, "region": region, "para": i, "stmt_id": n, "slot": k, "column": pair.get("column"), "host_var": pair["hostVar"],
                "derived": pair.get("derived", False), "expression": pair.get("expression"), "derived_from": pair.get("derivedFrom", []),
            }


def table_rows(program: dict) -> Iterator[dict]:
    """Base tables that SQL statements name."""
    for u, region, i, n, s in exec_statements(program):
        if s["lang"] == "SQL":
            for k, name in enumerate(table_refs(mask_literals(s["text"].upper()))):
                yield {"unit": u, "region": region, "para": i, "stmt_id": n, "ord": k, "table": name, "verb": s["verb"]}


def cursor_rows(program: dict) -> Iterator[dict]:
    for u, unit in units(program):
        for c in unit["sql_cursors"]:
            yield {"unit": u, "cursor": c["cursor"], "table": c["table"], "tables": c["tables"], "for_kind": c["forKind"], "for_statement": c["forStatement"], "line": c["line"], "columns": c["selectList"]}


def copybook_rows(program: dict) -> Iterator[dict]:
    for i, row in enumerate(program["copybooks"]):
        yield {"ord": i, "copy_member": row["member"], "status": row["status"], "via": row["via"], "replacing": row["replacing"], "line": row["line"], "parent": row["parent"], "source": row.get("source")}


def need_rows(program: dict) -> Iterator[dict]:
    """What a program depends on, as manifest rows: kind, dependency, where."""
    seen: set[tuple[str, str]] = set()

    def need(kind: str, name: str | None, identity: str) -> Iterator[dict]:
        if name and (kind, name) not in seen:
            seen.add((kind, name))
            yield {"kind": kind, "dependency": name, "identity": identity}

    for row in program["copybooks"]:
        yield from need("copybook", row["member"], "named")
    for _, unit in units(program):
        for f in unit["files"].values():
            yield from need("file", f.get("assign") or f["file"], "named")
    for u, region, _, p in regions(program):
        for s in cp.walk(p["statements"]):
            if s["t"] == "CallStmt":
                yield from need("program", s["target"], "dynamic" if s["dynamic"] else "named")
            elif s["t"] == "ExecStmt" and s["kind"] in ("call", "transfer"):
                yield from need("program", s["target"], "dynamic" if s["dynamic"] else "named")
    for row in table_rows(program):
        yield from need("db2-table", row["table"], "named")


# ---- who is assigned what, for calls by a data item


def character_length(pic: str | None, usage: str | None) -> int | None:
    pic = (pic or "").strip().rstrip(".")
    return len(expand_pic(pic)) if pic and pic_type(pic, usage)["category"] in CHARACTER else None


def assignment_rows(program: dict) -> Iterator[dict]:
    """Facts about data items of the outer program: declared, size, literal, variable, condition, missing.

    ``literal`` and ``variable`` are assignments by VALUE, MOVE and SET TO
    TRUE in its main paragraphs; an opaque source has no value.
    """
    fact = lambda kind, name, value=None, size=None: {"kind": kind, "name": name, "value": value, "size": size}
    items = program["data_items"]
    for x in items:
        if cp.quoted(x["value"]):
            yield fact("literal", x["name"], x["value"][1:-1].rstrip())
        if x["level"] != 88:
            yield fact("size", x["name"], None, character_length(x["pic"], x["usage"]))
    when_true: dict[str, tuple[str, str]] = {}
    for name, i in program["data_by_name"].items():
        yield fact("declared", name)
        values = [v.strip("'\"") for v in items[i]["condition_values"] if v[:1] in ("'", '"')]
        if items[i]["cond_parent"] and values:
            when_true[name] = (items[i]["cond_parent"], values[0])
            for v in values:
                yield fact("condition", items[i]["cond_parent"], v)
    for row in program["copybooks"]:
        if row["status"] == "missing":
            yield fact("missing", row["member"])
    for p in program["paragraphs"]:
        for s in cp.walk(p["statements"]):
            if s["t"] != "Action":
                continue
            if s["verb"] == "MOVE" and (m := re.match(r"MOVE\s+(.+)$", s["text"].strip(), re.I)):
                sides = split_outside_literals(m[1], "TO")
                for t in re.split(r"[\s,]+", sides[1].strip()) if sides else ():
                    source = sides[0].strip()
                    if not is_name(t):
                        continue
                    if source[:1] in ("'", '"'):
                        yield fact("literal", t.upper(), source.strip("'\"").rstrip())
                    else:
                        yield fact("variable", t.upper(), plain_name(source))
            elif s["verb"] == "SET" and (behind := (words := Words(s["text"])).phrase("TO", "TRUE")):
                for t in words.up[1 : behind - 2]:
                    if t in when_true:
                        yield fact("literal", *when_true[t])


def dynamic_call_rows(program: dict) -> Iterator[dict]:
    """Calls by a data item: its name, and how many characters the operand passes (8 through CICS)."""
    for u, region, i, p in regions(program):
        for n, s in enumerate(cp.walk(p["statements"])):
            if s["t"] == "CallStmt" and s["dynamic"] and s["target"] != "?":
                yield {"unit": u, "para": i, "stmt_id": n, "name": s["target"], "operand_limit": None}
            elif s["t"] == "ExecStmt" and s["kind"] in ("call", "transfer") and s["dynamic"]:
                yield {"unit": u, "para": i, "stmt_id": n, "name": s["target"], "operand_limit": 8}
